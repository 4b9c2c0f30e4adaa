"""A PySpark-native analytics engine for event outcomes, prices and text corpora."""
