"""Queries: the operators bound to the given tables, with SQL to compare with."""
