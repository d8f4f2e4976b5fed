"""Spark-native rule-driven text analytics."""
