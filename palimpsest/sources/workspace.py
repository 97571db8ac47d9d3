"""Where queries keep tables of their own: the folder that the session names in spark.checkpoint.dir.

A session without that setting gets a temporary folder only if it runs in one process on this machine, as in tests. Elsewhere
executors would not see such a folder, so the setting is asked for.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def workspace(spark: SparkSession, tag: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
