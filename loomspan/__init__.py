"""Spark-native post-training data and evaluation engine."""

__version__ = "0.1.0"
