"""Sequence-graph seed finding and the data processing around it, on Spark DataFrames."""
