"""Transforms of DataFrames, free of any table's name."""
