"""Larder: price-archive analytics on Spark DataFrames."""
