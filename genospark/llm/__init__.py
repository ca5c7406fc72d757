"""Operators of a training-data pipeline over Spark DataFrames. Nothing outside this subpackage imports it."""
