"""A PySpark-native engine for turning messy listings into ranked, explained, evaluated tables."""
