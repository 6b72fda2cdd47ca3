"""vitalink: identity search, aggregation and record linkage on Spark DataFrames."""
