"""PySpark-native causal event analytics."""
