"""Alert grouping and lifecycle analytics on Spark DataFrames."""
