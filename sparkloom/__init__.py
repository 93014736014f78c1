"""Spark-native code and document analytics."""
