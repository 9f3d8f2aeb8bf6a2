"""Raster and elevation analytics on Spark DataFrames."""
