"""Document-signal analytics on PySpark: DataFrame-in, DataFrame-out operators."""
