"""Regional energy-demand analytics on Spark DataFrames."""
