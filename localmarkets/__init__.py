"""Spark-native analytics over local event and venue listings."""
