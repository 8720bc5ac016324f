"""Spark-native analytics over tiered decision policies and training-data tables."""
