"""quillstack: a PySpark-native engine for scholarly citation metadata."""
