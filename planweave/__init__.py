"""Spark-native analytics for spatial captures and training corpora."""

__version__ = "0.1.0"
