"""Job-posting collection and model-score measurement on Spark DataFrames."""
