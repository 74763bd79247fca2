"""Column expressions of the registry: text, numbers and small folds. None uses a row UDF."""
