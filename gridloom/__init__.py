"""Array and record analytics on Spark DataFrames."""
