"""Reads over an op-log: every read is a declarative query that Catalyst plans.

Newest-wins reads aggregate with max_by, which combines before the shuffle, so a key with a third of all
versions costs one row a task. Where all columns have a fixed width, versions are hashed into place and never sorted.
Tombstones are dropped only after the newest version is known.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palimpsest.model import DELETE, PUT, STANDARD, Columns

#: Types that an aggregation can update in place, which is what lets it hash in place of sorting.
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_SHORT_INTS = (T.ByteType, T.ShortType, T.IntegerType)


def _bound(df: DataFrame, key: str, start, end) -> DataFrame:
    """start <= key < end; None leaves a side open. Literal bounds reach the scan."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(key) < F.lit(end))
    return df


def latest(df: DataFrame, key: list[str], order: list[str], c: Columns = STANDARD) -> DataFrame:
    """Of each key the row that is greatest in the order columns; columns as in df, keys first, order columns that begin with __ left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    others = [x for x in df.columns if x not in key and not x.startswith("__")]
    fixed = all(isinstance(kinds[x], _FIXED) or x == c.op for x in others)
    place = F.struct(*order)
    if fixed and all(isinstance(kinds[x], (*_SHORT_INTS, T.LongType)) for x in order):
        first, last = kinds[order[0]], kinds[order[-1]]
        if len(order) == 1:
            place = F.col(order[0])
        elif len(order) == 2 and (isinstance(last, _SHORT_INTS) or isinstance(first, _SHORT_INTS)):
            # one number in place of two: the second lies within half the distance that the first is multiplied by
            bits = 32 if isinstance(last, _SHORT_INTS) else 64
            place = F.col(order[0]).cast("decimal(20,0)") * F.lit(Decimal(2**bits)) + F.col(order[1]).cast("decimal(20,0)")
        else:
            fixed = False
    else:
        fixed = False
    if not fixed:
        return df.groupBy(*key).agg(F.max_by(F.struct(*others), place).alias("__v")).select(*key, "__v.*")
    # an operation is either of two, so a flag stands for its name
    one = lambda x: F.when(F.max_by(F.col(x) == DELETE, place), DELETE).otherwise(PUT) if x == c.op and isinstance(kinds[x], T.StringType) else F.max_by(x, place)
    return df.groupBy(*key).agg(*[one(x).alias(x) for x in others])


def newest(log: DataFrame, read_ts: int | None = None, c: Columns = STANDARD, tie: list[str] | None = None) -> DataFrame:
    """The newest version of each key at read_ts, tombstones included. `tie` orders versions of equal timestamp."""
    seen = log if read_ts is None else log.where(F.col(c.ts) <= F.lit(read_ts))
    return latest(seen, [c.key], [c.ts, *(tie if tie is not None else [x for x in ("op_seq",) if x in log.columns])], c)


def snapshot(log: DataFrame, read_ts: int | None = None, c: Columns = STANDARD, tie: list[str] | None = None) -> DataFrame:
    """Live keys at read_ts (None: now) with their visible version."""
    return newest(log, read_ts, c, tie).where(F.col(c.op) != DELETE)


def scan(log: DataFrame, start=None, end=None, read_ts: int | None = None, limit: int | None = None, tombstones: bool = False, c: Columns = STANDARD) -> DataFrame:
    """Keys in [start, end) in key order; limit 0 or None is unlimited."""
    found = newest(_bound(log, c.key, start, end), read_ts, c)
    found = (found if tombstones else found.where(F.col(c.op) != DELETE)).orderBy(c.key)
    return found.limit(limit) if limit else found


def prefix_range(prefix: str | bytes):
    """[start, end) of all keys that begin with prefix; end is None when no key can lie above it."""
    if isinstance(prefix, str):
        raw = [ord(x) for x in prefix]
        while raw and raw[-1] == 0x10FFFF:
            raw.pop()
        step = 0xE000 - 0xD7FF if raw and raw[-1] == 0xD7FF else 1
        return prefix, ("".join(map(chr, [*raw[:-1], raw[-1] + step])) if raw else None)
    data = bytearray(prefix)
    while data and data[-1] == 0xFF:
        data.pop()
    return bytes(prefix), (bytes([*data[:-1], data[-1] + 1]) if data else None)


def prefix_scan(log: DataFrame, prefix, read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    start, end = prefix_range(prefix)
    return scan(log, start, end, read_ts, c=c)


def seek(log: DataFrame, target, page: int, read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    """A page of keys from target on; pass the last key's successor to go on (keyset pagination)."""
    return scan(log, target, None, read_ts, page, c=c)


def get(log: DataFrame, key, read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    """The live version of one key; the equality reaches the scan."""
    return snapshot(log.where(F.col(c.key) == F.lit(key)), read_ts, c)


def multi_get(log: DataFrame, keys: DataFrame, key_col: str = "key", read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    """Every requested key once, with its live version and `found`. Requested keys are shuffled once with the versions."""
    wanted = keys.select(F.col(key_col).alias(c.key)).distinct()
    live = snapshot(log.join(wanted, c.key, "left_semi"), read_ts, c)
    return wanted.join(live.withColumn("found", F.lit(True)), c.key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contains(log: DataFrame, keys: DataFrame, key_col: str = "key", read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    return multi_get(log, keys, key_col, read_ts, c).select(c.key, "found")


def deleted_keys(log: DataFrame, read_ts: int | None = None, c: Columns = STANDARD) -> DataFrame:
    """Keys whose newest version is a tombstone."""
    return newest(log, read_ts, c).where(F.col(c.op) == DELETE)


def history(log: DataFrame, c: Columns = STANDARD) -> DataFrame:
    """All versions, newest first inside a key, with their rank."""
    w = Window.partitionBy(c.key).orderBy(F.desc(c.ts), *[F.desc(x) for x in ("op_seq",) if x in log.columns])
    return log.withColumn("version_rank", F.row_number().over(w).cast("bigint"))


def merge_newest_wins(sources: list[DataFrame], c: Columns = STANDARD, tombstones: bool = False) -> DataFrame:
    """Union of sources given newest first: per key the first source holding it wins, inside a source the newest version."""
    tagged = [s.withColumn("__src", F.lit(-i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for s in tagged[1:]:
        union = union.unionByName(s)
    best = latest(union, [c.key], ["__src", c.ts], c)
    return best if tombstones else best.where(F.col(c.op) != DELETE)


def overlay(snapshot_df: DataFrame, buffer: DataFrame, c: Columns = STANDARD) -> DataFrame:
    """Read-your-writes: a transaction's buffered operations over a snapshot."""
    own = newest(buffer, c=c)
    rest = snapshot_df.join(own.select(c.key), c.key, "left_anti")
    return rest.unionByName(own.where(F.col(c.op) != DELETE).select(*snapshot_df.columns))


def asof(probes: DataFrame, log: DataFrame, key: str = "key", at: str = "at", c: Columns = STANDARD, span: int | None = None) -> DataFrame:
    """Each probe with the latest version of its key at or before `at`, tombstones included; null when there is none.

    Probes and versions of a key are merged by time and the last version is carried forward, so the cost is
    their sum, not their product. With span, a key's time line is cut into stretches of that length that run
    in parallel (for a hot key); each stretch starts from the last version before it.
    """
    carried = F.struct(*[F.col(x) for x in log.columns if x != c.key])
    left = probes.select(F.col(key).alias("__k"), F.col(at).cast("bigint").alias("__t"), F.lit(1).alias("__probe"), F.struct(*probes.columns).alias("__p"), F.lit(None).cast(log.select(carried.alias("v")).schema["v"].dataType).alias("__v"))
    right = log.select(F.col(c.key).alias("__k"), F.col(c.ts).alias("__t"), F.lit(0).alias("__probe"), F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), carried.alias("__v"))
    parts = ["__k"]
    if span:
        stretch = F.floor(F.col("__t") / span)
        left, right = left.withColumn("__s", stretch), right.withColumn("__s", stretch)
        ends = right.groupBy("__k", "__s").agg(F.max_by("__v", "__t").alias("__v"))
        needed = left.select("__k", "__s").distinct().withColumn("__v", F.lit(None).cast(ends.schema["__v"].dataType)).withColumn("__q", F.lit(1))
        lines = ends.withColumn("__q", F.lit(0)).unionByName(needed)
        before = F.last("__v", True).over(Window.partitionBy("__k").orderBy("__s", F.desc("__q")).rowsBetween(Window.unboundedPreceding, 0))
        starts = lines.withColumn("__b", before).where("__q = 1 and __b is not null")
        right = right.unionByName(starts.select("__k", (F.col("__s") * span).alias("__t"), F.lit(-1).alias("__probe"), F.lit(None).cast(left.schema["__p"].dataType).alias("__p"), F.col("__b").alias("__v"), "__s"))
        parts.append("__s")
    w = Window.partitionBy(*parts).orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right).withColumn("__v", F.last("__v", True).over(w)).where("__probe = 1")
    return merged.select("__p.*", *[F.col(f"__v.{x}").alias(x if x not in probes.columns else f"version_{x}") for x in log.columns if x != c.key])


def stats(log: DataFrame, c: Columns = STANDARD, size: Column | None = None) -> DataFrame:
    """entry_count (distinct keys, tombstones included), approximate_size, tombstones and last_commit_ts."""
    size = size if size is not None else F.coalesce(F.length(F.col(c.key).cast("string")), F.lit(0)) + F.coalesce(F.length(F.col(c.value).cast("string")), F.lit(0))
    return log.agg(
        F.countDistinct(c.key).alias("entry_count"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("approximate_size"),
        F.count_if(F.col(c.op) == DELETE).alias("tombstones"),
        F.max(c.ts).alias("last_commit_ts"),
    )


def conflicts(writes: DataFrame, log: DataFrame, c: Columns = STANDARD) -> DataFrame:
    """Rows of writes (key, start_ts) whose key has a version committed after start_ts, tombstones included.

    Only a key's greatest timestamp matters, so versions are reduced before the join.
    """
    last = log.groupBy(c.key).agg(F.max(c.ts).alias("__last"))
    return writes.join(last, c.key).where(F.col("__last") > F.col("start_ts")).drop("__last")
