"""Spark-native analysis of positioned document text and its review history."""
