"""PySpark-native corpus preparation and evaluation."""
