"""A PySpark-native text-analytics engine."""
