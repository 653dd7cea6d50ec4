"""millrace: a PySpark-native engine for listing-style records and text corpora."""

__version__ = "0.1.0"
