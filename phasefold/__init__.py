"""State-space analytics and data-quality operators on Spark DataFrames."""
