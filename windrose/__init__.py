"""Weather-operations analytics on Spark DataFrames."""
