"""lakepress: a PySpark-native analytics engine for news-style document collections."""
