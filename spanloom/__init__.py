"""spanloom: span analytics for annotated text on Spark DataFrames."""
