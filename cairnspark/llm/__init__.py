"""Operators for large training-data pipelines, each over whole tables."""
