"""Co-occurrence network analytics on Spark DataFrames."""
