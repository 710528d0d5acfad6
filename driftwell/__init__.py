"""Retrieval-drift analytics planned as Spark DataFrame operations."""
