"""tidemark: a PySpark-native engine for versioned tables, their maintenance analytics and text search."""
