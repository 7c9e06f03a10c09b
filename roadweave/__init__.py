"""Road networks from raw GPS fixes, as Spark DataFrames."""
