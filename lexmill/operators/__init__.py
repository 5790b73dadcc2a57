"""Retrieval, ranking, evaluation and diagnostics over DataFrames."""
