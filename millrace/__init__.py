"""Millrace: a PySpark-native engine for preparing, auditing, retrieving and evaluating text corpora."""

__version__ = "0.1.0"
