"""Column builders. All of them are native Spark expressions unless they say otherwise."""
