"""Semantic-map analytics on Spark DataFrames."""
