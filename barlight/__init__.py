"""Barlight: session state, levels, regimes and ranges over price bars, on Spark DataFrames."""
