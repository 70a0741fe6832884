"""Analytics over corpora of graded tasks, as Spark DataFrame operations."""
