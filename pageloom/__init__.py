"""Spark-native indexing and search of the text recovered from images."""
