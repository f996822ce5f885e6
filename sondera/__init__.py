"""Similarity-based anomaly scoring and metadata analytics on Spark DataFrames."""
