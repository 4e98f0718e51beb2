"""corpusgraph: a PySpark-native engine that turns a literature corpus into clean, typed triples."""

__version__ = "0.1.0"
