"""Analytics for large collections of two-sided contests on Apache Spark."""
