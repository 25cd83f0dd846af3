"""Catalog analytics, matching and linkage for loosely structured sheets, on Spark DataFrames."""
