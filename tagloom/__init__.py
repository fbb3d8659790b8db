"""Spark-native document tagging analytics."""
