"""weftline: a PySpark-native analytics and machine-learning library."""

__version__ = "0.1.0"
