"""Spark-first analytics over versioned, content-addressed data."""
