"""Spark-native annotated data frames, contract-checked pipelines and step library."""

__version__ = "0.1.0"
