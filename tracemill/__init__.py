"""Spark-native analytics for rollout logs, preference pairs and evaluation data."""
