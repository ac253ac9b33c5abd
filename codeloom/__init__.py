"""codeloom: a PySpark-native engine for analysing source code and code datasets."""

__version__ = "0.1.0"
