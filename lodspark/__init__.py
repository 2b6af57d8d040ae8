"""lodspark: linked historical data operations as Spark DataFrames."""
