"""Operators: DataFrames from DataFrames."""
