"""Readers of recognised pages and structured page results."""
