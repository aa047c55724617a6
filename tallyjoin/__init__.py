"""Spark-native equi-join, row-expansion and corpus-preparation operators."""
