"""A pipeline engine whose operators are Spark DataFrame plans."""
