"""A PySpark-native engine for studying the provenance of text and source-code corpora."""
