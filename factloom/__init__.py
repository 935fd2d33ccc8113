"""factloom: a PySpark-native engine for checking numeric statements against published statistics."""
