"""Communication-archive analytics on Spark: every operator is DataFrame in, DataFrame out."""

__version__ = "0.1.0"
