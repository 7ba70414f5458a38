"""Analytics over linked document collections, on Spark DataFrames."""
