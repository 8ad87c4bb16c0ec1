"""A PySpark-native retrieval and indexing engine."""
