"""Spark-native analytics for collections of related DNA sequences."""

__version__ = "0.1.0"
