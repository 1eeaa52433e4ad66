"""Operators on DataFrames of selections, answers and events."""
