"""A PySpark-native engine for passage retrieval analytics and text data preparation."""

__version__ = "0.1.0"
