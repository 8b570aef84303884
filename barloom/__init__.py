"""Spark-native analytics for daily security panels (symbol x trading date)."""
