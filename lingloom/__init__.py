"""Spark-native curation of parallel and instruction text corpora."""
