"""Windowed event analytics and temporal checks on Spark DataFrames."""
