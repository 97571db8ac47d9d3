"""Row shapes shared by the whole engine.

An op-log row is one version of a key: (key, commit_ts, op, value, op_seq). Keys and values may be of any
orderable or storable type; binary keys order as unsigned bytes, shorter prefixes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

PUT, DELETE = "PUT", "DELETE"


@dataclass(frozen=True)
class Columns:
    """Names of an op-log's columns."""

    key: str = "key"
    ts: str = "commit_ts"
    op: str = "op"
    value: str = "value"


STANDARD = Columns()


def oplog(df: DataFrame, key: Column | str, ts: Column | str, value: Column | str, deleted: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Any table as an op-log: `deleted` marks tombstones, `seq` orders operations of one timestamp."""

    def as_column(x: Column | str) -> Column:
        return F.col(x) if isinstance(x, str) else x

    op = F.when(deleted, DELETE).otherwise(PUT) if deleted is not None else F.lit(PUT)
    return df.select(
        as_column(key).alias("key"),
        as_column(ts).cast("bigint").alias("commit_ts"),
        op.alias("op"),
        F.when(op == PUT, as_column(value)).alias("value"),
        (seq if seq is not None else F.lit(0)).cast("int").alias("op_seq"),
    )
