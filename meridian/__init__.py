"""Spark-native analytics over competitive events, catalogues and corpora."""
