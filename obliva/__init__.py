"""PySpark-native auditing and preparation of language-model data."""
