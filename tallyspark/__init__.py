"""Transaction-ledger analytics on Spark DataFrames."""
