"""larkspur: a Spark-native engine for retrieval, ranking and corpus processing."""

__version__ = "0.1.0"
