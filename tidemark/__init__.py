"""Multi-version key/value analytics and training-data operators on Spark DataFrames."""
