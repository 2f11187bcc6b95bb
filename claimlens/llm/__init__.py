"""Operators of training-data jobs: tokens, duplicates, contamination, language, markup, search."""
