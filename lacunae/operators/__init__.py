"""Relational operators over series: grid, segments, features, origins, splits, scores and tests."""
