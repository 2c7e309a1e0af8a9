"""Spark-native content-addressed artifact analytics."""
