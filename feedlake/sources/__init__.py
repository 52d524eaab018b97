"""Feed files, stores and logs as DataFrames."""
