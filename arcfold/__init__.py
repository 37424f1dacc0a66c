"""Graph analytics on Spark: a graph is two DataFrames, and every operation is a plan over them."""
