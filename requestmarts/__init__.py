"""Spark-native analytics over citizen service requests."""
