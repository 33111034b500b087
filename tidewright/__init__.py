"""A PySpark-native engine for market time series and text corpora."""
