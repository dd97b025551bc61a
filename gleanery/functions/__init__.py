"""Column functions: native Spark expressions, no data movement."""
