"""Siltstone: a Spark-native engine for content identity, near-duplicate search and corpus work."""
