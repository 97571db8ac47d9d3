"""Versioned, ordered key-value analytics expressed as Spark DataFrames."""
