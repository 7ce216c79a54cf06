"""Layout-text scoring and analytics on Spark DataFrames."""
