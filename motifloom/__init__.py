"""Motif scanning, chain alignment and related analytics on Spark DataFrames."""
