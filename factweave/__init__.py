"""Factweave: a PySpark-native engine for facts (subject, predicate, object), graphs and code corpora."""

__version__ = "0.1.0"
