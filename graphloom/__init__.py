"""Property-graph pattern queries and large-scale data operators on Spark DataFrames."""
