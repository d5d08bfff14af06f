"""Knowledge graphs from mappings, on Spark DataFrames."""
