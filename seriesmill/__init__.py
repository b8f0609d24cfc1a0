"""A PySpark-native engine for hierarchical and tagged metric series."""
