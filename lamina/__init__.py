"""Spark-native analytics over file-history and content-addressed snapshot data."""
