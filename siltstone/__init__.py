"""A PySpark-native engine for document retrieval and answer-evaluation analytics."""
