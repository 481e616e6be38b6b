"""Readers, literal tables, sinks and the mapping from the star-schema tables."""
