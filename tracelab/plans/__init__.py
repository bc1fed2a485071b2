"""Queries over the test tables, and the same as SQL."""
