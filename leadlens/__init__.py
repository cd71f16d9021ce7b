"""Lead-quality analytics on Spark."""
