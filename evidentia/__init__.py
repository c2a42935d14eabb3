"""Evidence retrieval and record preparation on Spark DataFrames."""
