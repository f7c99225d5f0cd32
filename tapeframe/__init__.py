"""Combining several imperfect recordings of one sequence, on Spark DataFrames."""
