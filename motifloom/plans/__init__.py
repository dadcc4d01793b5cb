"""Registered queries, by subject, each with its SQL where SQL can say it."""
