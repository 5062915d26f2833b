"""Readers and parsers of captured records."""
