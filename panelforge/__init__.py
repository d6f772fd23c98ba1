"""A PySpark-native engine for entity-by-time panels."""
