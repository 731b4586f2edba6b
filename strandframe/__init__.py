"""strandframe: record processing on Spark DataFrames."""
