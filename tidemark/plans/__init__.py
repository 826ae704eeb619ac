"""The two queries, over tables, over change logs and over streams."""
