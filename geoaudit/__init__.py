"""A PySpark-native engine for auditing whether a binary outcome is spread evenly over space."""
