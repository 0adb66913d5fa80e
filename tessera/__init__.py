"""Spark-native analytics for text and code corpora."""
