"""A PySpark-native toolkit for the work of a cloud data warehouse."""
