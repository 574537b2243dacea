"""Spark-native analytics for airborne sensor surveys and map-matched navigation."""
