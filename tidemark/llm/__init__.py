"""Operators for preparing training data, each with a query of the same name."""
