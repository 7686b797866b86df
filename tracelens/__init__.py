"""Digital-exposure analytics and corpus preparation on Spark DataFrames."""
