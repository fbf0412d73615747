"""Property-graph and vector analytics on PySpark DataFrames."""
