"""Operators: plans from DataFrames to DataFrames."""
