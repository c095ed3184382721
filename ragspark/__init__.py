"""A PySpark-native engine for retrieval, evaluation and corpus preparation."""
