"""Document and vector search on Spark DataFrames."""
