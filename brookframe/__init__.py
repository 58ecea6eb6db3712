"""Spark-native processing of partitioned record streams."""
