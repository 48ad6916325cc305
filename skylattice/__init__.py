"""Spark-first analytics for keyed position events."""
