"""Operators: each takes and returns DataFrames and works on any table."""
