"""Graph analytics on Spark: property graphs as DataFrames, operators as lazy plans."""
