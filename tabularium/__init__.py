"""Table analysis and training-data jobs on Spark DataFrames."""
