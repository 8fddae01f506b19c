"""Operators on DataFrames: spatial joins, statistics, rasters, graphs."""
