"""Column expressions whose results differ from Spark's defaults."""
