"""Relational operators of the records model: filters, keys, quality rules, updates."""
