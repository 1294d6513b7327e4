"""A PySpark-native engine for searching, faceting, browsing and indexing library records."""
