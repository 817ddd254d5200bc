"""Rule discovery and data quality on Spark DataFrames."""
