"""Spark-native analytics over dependency graphs, and the data operations around them."""
