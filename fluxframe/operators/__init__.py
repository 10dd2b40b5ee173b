"""Joins, groups, windows, reshaping, missing data and statistics over DataFrames."""
