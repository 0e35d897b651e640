"""Furrow: field-level satellite analytics on Spark DataFrames."""
