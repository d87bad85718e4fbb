"""gridloom: retrieval, vector search and text processing on Spark DataFrames."""
