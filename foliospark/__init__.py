"""foliospark: a PySpark-native engine for versioned Markdown collections."""

__version__ = "0.1.0"
