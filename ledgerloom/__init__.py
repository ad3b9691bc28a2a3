"""Spark-native account reconciliation on DataFrames."""
