"""Spark-native geospatial reconstruction analytics."""
