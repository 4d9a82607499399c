"""Fathom: a tabular analytics engine on Spark DataFrames."""
