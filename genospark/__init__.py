"""Short-read sequencing analytics on Spark DataFrames."""
