"""Spark-native span masking engine."""
