"""Spark-native store, ranking and analytics for the long-term memory of software agents."""
