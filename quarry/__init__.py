"""Document, search, vector, graph and bitemporal queries over Spark DataFrames."""
