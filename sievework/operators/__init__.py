"""DataFrame operators: each takes DataFrames and returns lazy DataFrames."""
