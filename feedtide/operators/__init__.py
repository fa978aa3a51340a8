"""Operators: DataFrames in, DataFrame out."""
