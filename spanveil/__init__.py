"""Sensitive-text analytics on Spark DataFrames."""
