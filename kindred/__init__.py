"""kindred: record linkage and analytics on Spark DataFrames."""
