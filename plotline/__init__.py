"""Analytics for property listings on Spark: search, market signals, statistics and feeds."""
