"""Whole plans: cleaning files, searching an index."""
