"""Retrieval, analytics and maintenance over text records, on Spark."""
