"""Readers, writers and the dirty projections of the given tables."""
