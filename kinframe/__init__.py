"""Entity-mapped analytics on Spark: DataFrames in, DataFrames out."""
