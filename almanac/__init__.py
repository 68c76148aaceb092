"""Seasonal time-series analytics over many series at once, on Spark DataFrames."""
