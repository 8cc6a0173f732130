"""A PySpark-native analytics engine for graphs of code, documents and vectors."""
