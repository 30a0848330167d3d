"""Plumbline: a PySpark-native engine for entity-by-period analytics."""
