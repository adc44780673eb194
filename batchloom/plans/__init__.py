"""Whole audits and the registered queries with their SQL."""
