"""Property-graph building, retrieval and evaluation on Spark DataFrames."""
