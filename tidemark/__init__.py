"""Leakage-safe market-bar analytics on Spark DataFrames."""
