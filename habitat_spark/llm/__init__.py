"""Training-data operators: ten corpus operations on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
