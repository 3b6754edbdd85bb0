"""PySpark-native wildfire event analytics."""
