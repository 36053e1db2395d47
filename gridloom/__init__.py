"""Gridded tables, field comparison and run-log analytics on Spark DataFrames."""
