"""Spark-native analytics for topological features of time-series panels."""
