"""Spark-native leakage, similarity and evaluation analytics."""
