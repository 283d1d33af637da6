"""Match-prediction analytics and training-data operators on Spark DataFrames."""
