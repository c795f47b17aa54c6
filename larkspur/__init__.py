"""Spark-native analytics for document retrieval: structure, search, context, evaluation, streams."""
