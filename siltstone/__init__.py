"""siltstone: Spark-native operators for documents, geodata and engineering tables."""

__version__ = "0.1.0"
