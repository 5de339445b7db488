"""Versioned-text and decision analytics on Spark DataFrames."""
