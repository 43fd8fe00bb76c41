"""recolta: a PySpark-native engine for capture memory retrieval and analytics."""

__version__ = "0.1.0"
