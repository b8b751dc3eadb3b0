"""Column helpers: each takes and returns Spark columns."""
