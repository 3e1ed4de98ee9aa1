"""A general-ledger analytics engine on Spark DataFrames."""
