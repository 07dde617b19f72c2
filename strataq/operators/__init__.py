"""Operators take DataFrames and column names, never fixed tables."""
