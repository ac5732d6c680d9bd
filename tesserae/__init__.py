"""Graph and document analytics on Spark DataFrames."""
