"""A PySpark-native analytics engine for text, vector and graph data."""
