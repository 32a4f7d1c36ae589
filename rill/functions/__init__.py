"""Types, expressions and the mapping of functions to Spark."""
