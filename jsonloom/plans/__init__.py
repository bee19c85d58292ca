"""Registered queries, and their SQL where SQL can express them."""
