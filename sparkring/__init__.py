"""Graph analytics as sparse linear algebra over semirings, on Spark DataFrames."""
