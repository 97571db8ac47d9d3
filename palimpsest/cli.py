"""Interactive commands over a store: put, get, delete, scan, info, help, exit.

    python -m palimpsest.cli PATH
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from palimpsest.sources.store import Store

HELP = "put KEY VALUE | get KEY | delete KEY | scan [START] [END] | info | help | exit"


def run_command(store: Store, line: str) -> str | None:
    """The answer to one command; None ends the session. Errors are answers too."""
    words = line.strip().split(None, 2)
    if not words:
        return ""
    verb, args = words[0].lower(), words[1:]
    try:
        if verb in ("exit", "quit"):
            return None
        if verb == "put" and len(args) == 2:
            store.put(args[0].encode(), args[1].encode())
            return "OK"
        if verb == "get" and len(args) == 1:
            value = store.get(args[0].encode())
            return "(nil)" if value is None else value.decode("utf-8", "replace")
        if verb == "delete" and len(args) == 1:
            store.delete(args[0].encode())
            return "OK"
        if verb == "scan":
            bounds = [a.encode() for a in args] + [None, None]
            rows = store.scan(bounds[0], bounds[1]).toLocalIterator()
            lines = [f"{bytes(r.key).decode('utf-8', 'replace')} -> {bytes(r.value).decode('utf-8', 'replace')}" for r in rows]
            return "\n".join([*lines, f"({len(lines)} entries)"])
        if verb == "info":
            return "\n".join(f"{k}: {v}" for k, v in store.status().items())
        return HELP
    except Exception as e:  # the session goes on
        return f"error: {e}"


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    try:
        store = Store(spark, argv[0])
        store.manifest()
    except FileNotFoundError:
        store = Store.create(spark, argv[0])
    for line in sys.stdin:
        answer = run_command(store, line)
        if answer is None:
            break
        print(answer, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
