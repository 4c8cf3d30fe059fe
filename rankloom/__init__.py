"""Ranked-evidence analytics on Spark DataFrames."""
