"""Linear-probe analytics on Spark."""
