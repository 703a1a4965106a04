"""Spark-native code-graph retrieval and analytics."""
