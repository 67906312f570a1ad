"""terralattice: open-map analytics on Spark DataFrames."""
