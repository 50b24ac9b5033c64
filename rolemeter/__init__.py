"""Spark-native scoring of documents against weighted role profiles."""

__version__ = "0.1.0"
