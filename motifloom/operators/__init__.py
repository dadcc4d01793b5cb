"""Operators on the library's tables."""
