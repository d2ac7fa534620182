"""weft: a PySpark-native engine for fuzzy clustering of embedding collections."""

__version__ = "0.1.0"
