"""Analytics over sparse "subject answered item under a condition" logs, on Spark."""
