"""Analytics and retrieval over agent histories on Spark."""
