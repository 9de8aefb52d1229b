"""PySpark-native analytics for ordered key-access data."""
