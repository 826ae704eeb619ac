"""Column expressions of the log format and of the two queries."""
