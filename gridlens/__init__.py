"""Spark-native analytics over semi-structured grids (see README)."""
