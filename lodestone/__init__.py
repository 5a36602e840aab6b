"""Text search, similarity, graph, event and simulation queries on Spark DataFrames."""
