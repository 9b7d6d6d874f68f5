"""Gridded climate and forest-disturbance analytics on Spark DataFrames."""
