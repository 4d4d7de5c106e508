"""Review analytics on Spark."""
