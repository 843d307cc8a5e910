"""Export files to typed rows. Parsing is native Spark wherever the format allows it;
the few formats that need a Python library are parsed inside ``mapInPandas``."""
