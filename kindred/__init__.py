"""Kindred: a PySpark-native engine that finds similar regions in large source and text collections."""

__version__ = "0.1.0"
