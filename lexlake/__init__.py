"""lexlake: assemble, curate, split and judge language datasets with Spark DataFrames."""
