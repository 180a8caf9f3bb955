"""Operators for large training-data corpora, each a composition of Spark jobs."""
