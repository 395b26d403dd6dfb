"""docloom: document analytics, retrieval and corpus preparation on Spark DataFrames."""
