"""Linear algebra, statistics and optimisation over Spark DataFrames."""
