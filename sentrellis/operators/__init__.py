"""Operators of the preference-data engine: from DataFrames to DataFrames."""
