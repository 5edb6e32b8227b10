"""tessera: dataset profiling, retrieval and context assembly on Spark DataFrames."""
