"""siftwell: a PySpark-native full-text search engine over Parquet segments."""
