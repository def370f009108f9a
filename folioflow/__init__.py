"""Spark-native passage retrieval and text analytics over multi-script corpora."""

__version__ = "0.1.0"
