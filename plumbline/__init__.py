"""plumbline: a PySpark-native engine for linking map sheets to street geometry."""
