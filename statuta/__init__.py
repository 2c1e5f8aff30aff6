"""Analytics over versioned regulatory documents, as Spark DataFrame functions."""
