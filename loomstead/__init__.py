"""loomstead: a PySpark-native engine for long-lived memory data."""
