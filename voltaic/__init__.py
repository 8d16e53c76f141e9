"""Spark-native analytics over meter, sensor and event data."""
