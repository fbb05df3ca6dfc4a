"""Spark-native itemset mining, inverted indexes and neighbourhood recommendation."""
