"""Lodestone: a Spark-native engine for recovering and querying tabular content."""
