"""Spark-native analytics engine for events assembled from sources without a shared key."""
