"""Time-series analytics for tagged metric points, on Spark DataFrames."""
