"""lexmill: document-retrieval analytics on Spark DataFrames."""
