"""Spark-native analytics over price bars, with an optional text-corpus subpackage (``llm``)."""
