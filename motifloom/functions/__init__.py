"""Scalar functions: sequences, penalties, text."""
