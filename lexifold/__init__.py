"""Spark-first literature retrieval, vocabulary analytics and record flattening."""
