"""Graph-pattern analytics, context records and round-based aggregation on Spark DataFrames."""
