"""Spark-native quantitative analytics: bars, features, signals, accounting, metrics."""
