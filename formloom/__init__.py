"""Spark-native analytics over page tokens, form fields and document corpora."""
