"""Patent-document analytics expressed as Spark DataFrames."""
