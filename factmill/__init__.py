"""Financial-evidence analytics on Spark DataFrames."""
