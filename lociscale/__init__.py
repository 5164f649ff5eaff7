"""Evaluating per-variant scores on Spark DataFrames."""
