"""A PySpark-native engine for vector and text retrieval."""
