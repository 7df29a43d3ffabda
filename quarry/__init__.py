"""A Spark-native engine for indexing source code and text, ranking retrieval results and tracing calls."""

__version__ = "0.1.0"
