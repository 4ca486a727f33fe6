"""Spark-native graph analytics, vertex ordering and training-data operators."""
