"""Error-bounded analytics of dense numeric fields on Spark DataFrames."""
