"""Graphs kept up to date from streams of records."""
