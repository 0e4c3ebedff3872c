"""tidewell: a PySpark-native engine for accumulated community posts and short texts."""
