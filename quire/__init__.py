"""Corpus preparation, indexing, retrieval and analytics as Spark DataFrame jobs."""
