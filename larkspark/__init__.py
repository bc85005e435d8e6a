"""A Spark-native engine for star-schema and nested data."""
