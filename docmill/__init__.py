"""docmill: document-data jobs on Spark DataFrames."""
