"""Operators over DataFrames: rules, reads, writes."""
