"""A PySpark-native engine for labelled metric time series."""
