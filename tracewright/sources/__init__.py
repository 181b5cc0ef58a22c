"""Readers of manufacturing files as DataFrames."""
