"""Lexmill: ranking documents against questions, and measuring the ranking, as Spark DataFrames."""
