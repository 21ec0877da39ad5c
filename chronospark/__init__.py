"""Spark-native event timeline and detection engine."""

__version__ = "0.1.0"
