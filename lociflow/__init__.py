"""Variant-candidate analytics on Spark DataFrames."""
