"""Text-memory analytics on Spark DataFrames."""
