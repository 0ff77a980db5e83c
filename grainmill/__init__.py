"""Grainmill: relational analytics and training-data preparation, written for Spark."""
