"""Spark-native engine for longitudinal records and large text corpora."""
