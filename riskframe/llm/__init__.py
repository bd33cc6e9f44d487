"""Operators for preparing training text, and the queries over the text tables."""
