"""Readers and writers of series and result tables."""
