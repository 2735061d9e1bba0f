"""termloom: inverted-index and term-dictionary analytics on Spark DataFrames."""
