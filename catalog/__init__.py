"""Registered queries with their equivalent ANSI SQL over the given tables."""
