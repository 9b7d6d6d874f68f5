"""Operators on gridded tables: DataFrames in, DataFrames out."""
