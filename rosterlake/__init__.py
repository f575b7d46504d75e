"""rosterlake: a PySpark-native analytics engine for pools of schema-less records."""

__version__ = "0.1.0"
