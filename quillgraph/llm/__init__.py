"""Training-data operators on Spark DataFrames; optional for the rest."""
