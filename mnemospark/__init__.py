"""Memory-graph analytics on Spark DataFrames."""
