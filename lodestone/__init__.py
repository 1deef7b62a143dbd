"""Spark-native document retrieval and governance engine."""

__version__ = "0.1.0"
