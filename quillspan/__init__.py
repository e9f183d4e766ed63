"""Spark-native text to knowledge-graph engine."""
