"""Spark-native analytics over semi-structured business documents."""

__version__ = "0.1.0"
