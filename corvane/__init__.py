"""Corvane: a PySpark-native engine for preparing and analysing training corpora."""

__version__ = "0.1.0"
