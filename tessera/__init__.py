"""Correspondence, interval-ownership and evidence operators on Spark DataFrames."""
