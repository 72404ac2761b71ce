"""Column builders; each takes columns and returns a column, for batch and streams alike."""
