"""Queries registered for the test tables, with their SQL."""
