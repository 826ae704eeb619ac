"""Change logs from text, parquet, tables and databases."""
