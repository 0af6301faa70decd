"""Training-data operators: ten DataFrame-in, DataFrame-out Spark jobs."""
