"""Spark-native tables, labels and comparisons for prediction-market data."""

__version__ = "0.1.0"
