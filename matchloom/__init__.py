"""Spark-native record linkage and match-set analytics."""
