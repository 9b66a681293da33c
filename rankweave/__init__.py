"""Spark-native evidence ranking: signal, novelty, graph, matching and comparison operators over DataFrames."""
