"""Spark-native analytics over versioned document corpora."""
