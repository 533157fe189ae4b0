"""fieldloom: a PySpark-native engine for document-field extraction data."""

__version__ = "0.1.0"
