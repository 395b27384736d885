"""Strictly typed analytics on DataFrames."""
