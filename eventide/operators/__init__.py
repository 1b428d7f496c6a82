"""Operators over event-time DataFrames."""
