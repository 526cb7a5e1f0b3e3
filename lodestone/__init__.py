"""Lodestone: packed binary assets as DataFrames, and the relational work on them, on Spark."""
