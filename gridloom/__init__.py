"""Grid and field analytics on Spark DataFrames."""
