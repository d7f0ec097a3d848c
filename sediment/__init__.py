"""Corpus analytics on Spark DataFrames."""
