"""Spark-native cleaning, conforming, reporting and comparing of messy tables."""
