"""Spark-first knowledge-retrieval and training-data analytics engine."""
