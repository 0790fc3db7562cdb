"""Quire: text and timeline analytics on Spark DataFrames."""
