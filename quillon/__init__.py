"""Prefix search, completion and faceted ranking over documents, as Spark DataFrames."""
