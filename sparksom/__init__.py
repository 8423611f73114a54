"""PySpark-native self-organizing maps, time-series features and data-pipeline operators."""
__version__ = "0.1.0"
