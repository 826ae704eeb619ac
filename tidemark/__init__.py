"""Change-log analytics on Spark: queries kept right under inserts and deletes.

A change log is a DataFrame of rows with an integer weight ``w`` (+1 insert,
-1 delete) and the ``epoch`` in which the change happened.  Joins multiply
weights, aggregates sum them, and a row exists while its net weight is positive.
"""
