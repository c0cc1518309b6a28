"""Code-graph and knowledge-search operators on Spark DataFrames."""
