"""A PySpark-native engine that indexes collections of documents."""
