"""Spark-native document retrieval, retrieval evaluation and training-data operators."""
