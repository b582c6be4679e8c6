"""ledgerloom: a PySpark-native engine for building and verifying evidence datasets."""

__version__ = "0.1.0"
