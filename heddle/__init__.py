"""heddle: a PySpark-native engine for join-aggregate and matrix-style analytics."""
