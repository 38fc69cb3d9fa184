"""Operators over rows (key, value)."""
