"""Spark-native analytics over curated text corpora."""
