"""weft: a Spark-native engine for context compilation and corpus preparation."""

__version__ = "0.1.0"
