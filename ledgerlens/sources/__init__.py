"""Readers of package files into DataFrames."""
