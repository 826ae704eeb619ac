"""Operators on change logs: DataFrame in, DataFrame out."""
