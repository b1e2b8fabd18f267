"""A market-pricing analytics engine on Spark."""
