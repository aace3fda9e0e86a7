"""Spark-native processing of scholarly-literature corpora."""

__version__ = "0.1.0"
