"""Eye-movement analytics on Spark DataFrames, one plan for a whole cohort of recordings."""
