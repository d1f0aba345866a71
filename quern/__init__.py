"""quern: a PySpark-native engine for MySQL-dialect analytics."""
