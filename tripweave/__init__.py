"""Transit-demand analytics on Spark DataFrames."""
