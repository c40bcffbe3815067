"""Replica comparison on Spark DataFrames."""
