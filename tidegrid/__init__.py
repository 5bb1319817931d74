"""Spatiotemporal demand analytics on Spark DataFrames."""
