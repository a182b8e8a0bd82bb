"""A PySpark-native engine that turns raw web pages into clean, structured, analysable text."""
