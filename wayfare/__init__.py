"""Spark-native urban accessibility and fare analytics."""
