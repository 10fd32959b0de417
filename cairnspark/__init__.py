"""Spark-first retrieval and document analytics."""
