"""Column rules: every function takes and returns native Spark columns."""
