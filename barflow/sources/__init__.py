"""Readers, writers and the bars that the queries derive from the given tables."""
