"""Spatio-temporal habitat analytics on Spark DataFrames."""
