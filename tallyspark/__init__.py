"""Spark-native analytics over documents, ledgers and decisions."""
