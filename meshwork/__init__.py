"""Graph connectivity and sparse algebra on Spark DataFrames."""
