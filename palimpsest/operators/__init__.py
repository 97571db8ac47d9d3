"""Reads, merges, transactions checks, maintenance and replication analytics over op-log DataFrames."""
