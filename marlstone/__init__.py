"""A PySpark-native analytics engine over path-addressed knowledge."""
