"""Tessera: interval, ordered-data and model operators on Spark DataFrames."""
