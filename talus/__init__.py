"""Talus: point-cloud granulometry on Spark DataFrames."""
