"""thicket: a PySpark-native engine for retrieval, graph analytics and corpus preparation over code and text."""

__version__ = "0.1.0"
