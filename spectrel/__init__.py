"""Spark-native mass-spectrometry analytics and corpus processing."""

__version__ = "0.1.0"
