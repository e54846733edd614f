"""plaza: PySpark-native queries over local-discovery data."""
