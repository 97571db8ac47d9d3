"""Training-data operators: classify, fingerprint, deduplicate, redact, extract, format, tokenise, pack.

Nothing outside this subpackage imports it (the driver entry does so behind a guard).
"""
