"""tessella: a PySpark-native analytics engine for statistical genomics tables."""
