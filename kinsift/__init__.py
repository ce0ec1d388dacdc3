"""Spark-native measurement and evaluation of similarity between source files."""

__version__ = "0.1.0"
