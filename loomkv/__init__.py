"""PySpark-native key-value analytics."""
