"""siltstone: a Spark-native engine for code retrieval, call graphs and text analytics."""

__version__ = "0.1.0"
