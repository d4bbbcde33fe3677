"""Decision-pattern analytics on Spark."""
