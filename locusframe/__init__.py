"""Spark-native analytics for life-science tables and text corpora."""
