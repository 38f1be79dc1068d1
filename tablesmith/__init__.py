"""Spark-native data preparation and analytics."""
