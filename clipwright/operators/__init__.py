"""Operators over the tables of `clipwright.staging`: DataFrames in, DataFrames out."""
