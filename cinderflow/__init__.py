"""Scoring, allocation and data-quality operators on Spark DataFrames."""
