"""Property-graph query intents on Spark DataFrames."""
