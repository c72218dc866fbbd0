"""Joins, components, grouping and ranking over DataFrames."""
