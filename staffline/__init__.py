"""Staff-history cleaning and profiling on Spark DataFrames."""
