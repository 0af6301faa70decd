"""Column functions: percentiles, tail probabilities, basis functions."""
