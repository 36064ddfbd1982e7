"""Repository profiles, sensitive-data scans and text assembly as Spark DataFrames."""
