"""claimloom: text-veracity analytics on Spark DataFrames."""
