"""Tessera: a Spark-native analytics engine for frames, ordered series and statistics."""

__version__ = "0.1.0"
