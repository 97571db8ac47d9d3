"""Applying a replicated log and watching leases with Structured Streaming."""
