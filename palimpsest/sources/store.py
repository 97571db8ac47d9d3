"""A versioned key-value store: sorted Parquet files under a manifest that advances by exclusive creation.

A commit writes its files first and then creates manifest n + 1; if that manifest exists, another commit
won and this one checks again. What is written but not yet in a manifest carries a marker, which keeps it from being
vacuumed. Readers pin one manifest, so compaction and collection never disturb them. Level 0 holds committed batches, level
1 files of about `target_bytes` of rows with disjoint key intervals. Timestamps continue from the manifest, also after a
restart. A key's newest version wins; inside one batch the last operation does. Keys are binary, string, bigint or int; null
keys are refused.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from bisect import bisect_left
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.model import DELETE, PUT
from palimpsest.operators import maintenance, read, replication
from palimpsest.sources.files import AlreadyThere, Files


class ConflictError(Exception):
    """A key written by the transaction has a version newer than its start."""


class FinishedError(Exception):
    """The transaction was committed or aborted before."""


def _pack(value):
    return {"hex": bytes(value).hex()} if isinstance(value, (bytes, bytearray)) else value


def _unpack(value):
    return bytes.fromhex(value["hex"]) if isinstance(value, dict) else value


@dataclass(frozen=True)
class Segment:
    """One sorted file (run/file). ts is set in a batch committed at one timestamp; else versions carry their own."""

    name: str
    level: int
    seq: int
    min_key: object
    max_key: object
    n_rows: int
    n_bytes: int
    min_ts: int
    max_ts: int
    ts: int | None = None

    def covers(self, start, end) -> bool:
        return not ((start is not None and self.max_key < start) or (end is not None and self.min_key >= end))

    def crosses(self, other: Segment) -> bool:
        return self.max_key >= other.min_key and self.min_key <= other.max_key


@dataclass(frozen=True)
class Staged:
    """A written batch that no manifest names yet."""

    run: str
    segments: tuple[Segment, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    last_ts: int
    key_type: str
    value_type: str
    applied_index: int = -1
    segments: tuple[Segment, ...] = field(default_factory=tuple)

    def dump(self) -> bytes:
        return json.dumps(asdict(self) | {"segments": [asdict(s) | {"min_key": _pack(s.min_key), "max_key": _pack(s.max_key)} for s in self.segments]}).encode()

    @staticmethod
    def load(data: bytes) -> Manifest:
        raw = json.loads(data)
        return Manifest(**raw | {"segments": tuple(Segment(**s | {"min_key": _unpack(s["min_key"]), "max_key": _unpack(s["max_key"])}) for s in raw["segments"])})


class Store:
    """l0_trigger batches on level 0 start a compaction after a commit; with l0_stop of them a writer compacts before it writes, so
    reads never have many more to merge. Batches are written by target_partitions tasks."""

    def __init__(self, spark: SparkSession, root: str, l0_trigger: int = 4, target_partitions: int | None = None, target_bytes: int = 128 << 20, l0_stop: int | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.l0_trigger, self.l0_stop = l0_trigger, l0_stop or 4 * l0_trigger
        self.partitions = target_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.target_bytes = target_bytes

    # ---- manifests

    @classmethod
    def create(cls, spark: SparkSession, root: str, key_type: str = "binary", value_type: str = "binary", **kw) -> Store:
        store = cls(spark, root, **kw)
        store.files.create("_manifest/00000000000000000000.json", Manifest(0, 0, key_type, value_type).dump())
        return store

    def manifest(self, version: int | None = None) -> Manifest:
        names = self.files.names("_manifest")
        if not names:
            raise FileNotFoundError(f"no store at {self.root}")
        return Manifest.load(self.files.read(f"_manifest/{names[-1] if version is None else f'{version:020d}.json'}"))

    def _advance(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Apply change to the newest manifest and create the next one; starts over when another writer was first."""
        while True:
            now = self.manifest()
            after = change(now)
            if after is None:
                return now
            after = replace(after, version=now.version + 1)
            try:
                self.files.create(f"_manifest/{after.version:020d}.json", after.dump())
                return after
            except AlreadyThere:
                continue

    def catalog(self) -> DataFrame:
        """The manifest as rows, lowest level and newest file first."""
        m = self.manifest()
        rows = [(s.name, s.level, s.seq, str(_pack(s.min_key)), str(_pack(s.max_key)), s.n_rows, s.n_bytes, s.min_ts, s.max_ts) for s in m.segments]
        schema = "file string, level int, seq bigint, min_key string, max_key string, n_rows bigint, n_bytes bigint, min_ts bigint, max_ts bigint"
        return self.spark.createDataFrame(rows, schema).orderBy("level", F.desc("seq"))

    # ---- reads

    def log(self, start=None, end=None, read_ts: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """All versions in [start, end) up to read_ts; files outside are not opened. Files of one batch, and all of level 1, are one scan."""
        m = manifest or self.manifest()
        schema = f"key {m.key_type}, commit_ts bigint, op string, value {m.value_type}, op_seq int"
        scans: dict[int | None, list[str]] = {}
        for s in m.segments:
            if s.covers(start, end) and (read_ts is None or s.min_ts <= read_ts):
                scans.setdefault(s.ts, []).append(f"{self.root}/data/{s.name}")
        out = None
        for ts, paths in scans.items():
            df = self.spark.read.schema(schema).parquet(*paths)
            if ts is not None:
                df = df.withColumn("commit_ts", F.lit(ts).cast("bigint"))
            out = df if out is None else out.unionByName(df)
        if out is None:
            out = self.spark.createDataFrame([], schema)
        if start is not None:
            out = out.where(F.col("key") >= F.lit(start))
        if end is not None:
            out = out.where(F.col("key") < F.lit(end))
        return out if read_ts is None else out.where(F.col("commit_ts") <= read_ts)

    def snapshot(self, read_ts: int | None = None) -> DataFrame:
        return read.snapshot(self.log(read_ts=read_ts))

    def scan(self, start=None, end=None, limit: int | None = None, read_ts: int | None = None, tombstones: bool = False) -> DataFrame:
        return read.scan(self.log(start, end, read_ts), start, end, read_ts, limit, tombstones)

    def multi_get(self, keys: DataFrame, read_ts: int | None = None) -> DataFrame:
        return read.multi_get(self.log(read_ts=read_ts), keys, read_ts=read_ts)

    def get(self, key, read_ts: int | None = None):
        """The live value of one key, or None. A job a call: prefer multi_get for many keys."""
        m = self.manifest()
        held = tuple(s for s in m.segments if s.min_key <= key <= s.max_key)
        row = read.get(self.log(manifest=replace(m, segments=held), read_ts=read_ts), key, read_ts).select("value").first()
        return None if row is None else bytes(row.value) if isinstance(row.value, bytearray) else row.value

    def create_view(self, name: str, read_ts: int | None = None) -> None:
        self.snapshot(read_ts).createOrReplaceTempView(name)

    # ---- writes

    def _write(self, rows: DataFrame, level: int, partitions: int, own_ts: bool, apart: list | None = None, n_rows: int | None = None) -> Staged | None:
        """Write rows (n_rows of them, if known) as sorted files with disjoint key intervals, unpublished; None when there are none. No
        file crosses one of the keys in `apart`."""
        run = uuid.uuid4().hex
        self.files.create(f"_staged/{run}", str(time.time()).encode())
        path = f"{self.root}/data/{run}"
        group = F.size(F.filter(F.array(*[F.lit(x) for x in apart]), lambda x: x <= F.col("key"))) if apart else F.lit(0)
        dealt = rows.withColumn("__group", group)
        dealt = dealt.repartitionByRange(partitions, "__group", "key") if partitions > 1 else dealt.coalesce(1)
        writer = dealt.sortWithinPartitions("__group", "key", F.desc("commit_ts"), F.desc("op_seq")).write
        # filters sized by the keys that a file holds; a fixed size would outweigh small files
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        if n_rows:
            writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, n_rows // partitions)))
        writer.partitionBy("__group").parquet(path)
        back = self.spark.read.schema(rows.schema).parquet(f"{path}/*")
        at = back.metadataColumn("_metadata")
        wide = {"string", "binary"}
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) if rows.schema[c].dataType.simpleString() in wide else F.lit(8) for c in ("key", "value")), F.lit(13))
        stats = [F.sum(size).alias("size"), F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n"), F.count("key").alias("k"), F.min("commit_ts").alias("t"), F.max("commit_ts").alias("u")]
        found = back.groupBy(at["file_path"].alias("p")).agg(*stats).collect() if self._has_files(path) else []
        if not found or any(x.n != x.k for x in found):
            self._drop(run)
            if found:
                raise ValueError("null keys can't be stored")
            return None
        raw = lambda v: bytes(v) if isinstance(v, bytearray) else v
        name = lambda p: f"{run}/{'/'.join(p.rsplit('/', 2)[1:])}"
        made = [Segment(name(x.p), level, 0, raw(x.a), raw(x.b), x.n, x["size"], x.t or 0, x.u or 0, None if own_ts else 0) for x in found]
        return Staged(run, tuple(sorted(made, key=lambda s: s.min_key)))

    def _has_files(self, path: str) -> bool:
        return any(n.startswith("__group=") for n in self.files.names(path.removeprefix(f"{self.root}/")))

    def _drop(self, run: str) -> None:
        self.files.remove(f"data/{run}")
        self.files.remove(f"_staged/{run}")

    def stage(self, ops: DataFrame, partitions: int | None = None) -> Staged | None:
        """Write a batch (key, op, value, op_seq if order matters) without making it visible."""
        m = self.manifest()
        if len({s.seq for s in m.segments if s.level == 0}) >= self.l0_stop:
            self.compact()
        seq = F.col("op_seq") if "op_seq" in ops.columns else F.lit(0)
        rows = ops.select(F.col("key").cast(m.key_type).alias("key"), F.lit(None).cast("bigint").alias("commit_ts"), F.col("op"), F.when(F.col("op") != DELETE, F.col("value")).cast(m.value_type).alias("value"), seq.cast("int").alias("op_seq"))
        last = read.newest(rows.withColumn("commit_ts", F.lit(0).cast("bigint"))).withColumn("commit_ts", F.lit(None).cast("bigint")).select(*rows.columns)
        return self._write(last, 0, partitions or self.partitions, False)

    def publish(self, staged: Staged | None, check: Callable[[Manifest], None] = lambda m: None, applied_index: int | None = None) -> int:
        """Make a staged batch visible at the next timestamp; its timestamp."""

        def change(m: Manifest) -> Manifest | None:
            check(m)
            if applied_index is not None and applied_index <= m.applied_index:
                return None
            after = m if applied_index is None else replace(m, applied_index=applied_index)
            if staged is None:
                return after if applied_index is not None else None
            if not self.files.names(f"data/{staged.run}"):
                raise FileNotFoundError(f"the staged batch {staged.run} was vacuumed before it was published")
            ts = m.last_ts + 1
            new = tuple(replace(s, ts=ts, seq=m.version + 1, min_ts=ts, max_ts=ts) for s in staged.segments)
            return replace(after, last_ts=ts, segments=(*m.segments, *new))

        after = self._advance(change)
        if staged is not None:
            self.files.remove(f"_staged/{staged.run}")
        if len({s.seq for s in after.segments if s.level == 0}) >= self.l0_trigger:
            try:
                self.compact()
            except Exception as e:  # the batch is committed, whatever becomes of the compaction
                warnings.warn(f"compaction after commit {after.last_ts} failed: {e}", RuntimeWarning, stacklevel=2)
        return after.last_ts

    def write(self, ops: DataFrame, replicas: int = 0, acks: Callable[[], DataFrame] | None = None, timeout: float = 5.0) -> int:
        """Commit a batch; with replicas, return once so many peers of acks() (peer_id, match_index) have reached its timestamp, or
        raise TimeoutError (the batch stays committed)."""
        ts = self.publish(self.stage(ops))
        if replicas:
            replication.await_replicas(acks, ts, replicas, timeout)
        return ts

    def write_rows(self, ops: list[tuple]) -> int:
        """A small batch of (op, key, value) in order, as one file."""
        return self.publish(self.stage(self._rows(ops), partitions=1))

    def _rows(self, ops: list[tuple]) -> DataFrame:
        m = self.manifest()
        return self.spark.createDataFrame([(k, op, v, i) for i, (op, k, v) in enumerate(ops)], f"key {m.key_type}, op string, value {m.value_type}, op_seq int")

    def put(self, key, value) -> int:
        return self.write_rows([(PUT, key, value)])

    def delete(self, key) -> int:
        return self.write_rows([(DELETE, key, None)])

    # ---- maintenance

    def compact(self, watermark: int | None = None) -> Manifest:
        """Merge level 0 and the level-1 files that its files overlap into new level-1 files, other files stay as they are; with a
        watermark, merge all and drop versions that no read at or after it needs."""
        m = self.manifest()
        new = [s for s in m.segments if s.level == 0]
        if watermark is None:
            inputs = (*new, *(s for s in m.segments if s.level > 0 and any(s.crosses(n) for n in new))) if new else ()
        else:
            inputs = m.segments
        if not inputs:
            return m
        merged = self.log(manifest=replace(m, segments=tuple(inputs)))
        if watermark is not None:
            merged = maintenance.collect_versions(merged, watermark)
        merged = merged.dropDuplicates(["key", "commit_ts", "op_seq"]).select("key", "commit_ts", "op", "value", "op_seq")
        files = max(1, -(-sum(s.n_bytes for s in inputs) // self.target_bytes))
        out = self._write(merged, 1, files, True, self._gaps(m, inputs), sum(s.n_rows for s in inputs))
        gone = {s.name for s in inputs}
        done = False

        def change(now: Manifest) -> Manifest | None:
            nonlocal done
            done = gone <= {s.name for s in now.segments}
            if not done:
                return None  # another compaction was first
            kept = tuple(s for s in now.segments if s.name not in gone)
            return replace(now, segments=(*kept, *(replace(s, seq=now.version + 1) for s in out.segments)) if out else kept)

        after = self._advance(change)
        if out:
            self.files.remove(f"_staged/{out.run}")
            if not done:
                self._drop(out.run)
        return after

    @staticmethod
    def _gaps(m: Manifest, inputs: tuple[Segment, ...]) -> list:
        """A key between each two neighbouring inputs that a staying level-1 file lies between: it must not come to lie inside the
        interval of a new file. No more keys than inputs."""
        gone, starts, gaps, passed = {s.name for s in inputs}, sorted(s.min_key for s in inputs), [], 0
        for s in sorted((s for s in m.segments if s.level > 0 and s.name not in gone), key=lambda s: s.min_key):
            before = bisect_left(starts, s.min_key)
            if passed < before < len(starts):
                gaps.append(s.min_key)
                passed = before
        return gaps

    def collect_garbage(self, watermark: int) -> Manifest:
        return self.compact(watermark)

    def vacuum(self, keep_versions: int = 1, staged_seconds: float = 7 * 86400) -> list[str]:
        """Delete manifests but the newest ones, and files that none of those names; the files and runs deleted. A run that is staged stays
        for staged_seconds, after which its writer is taken for dead."""
        runs = self.files.names("data")  # first: whatever is staged by now has its marker
        young = {r for r in self.files.names("_staged") if time.time() - float(self.files.read(f"_staged/{r}")) < staged_seconds}
        names = self.files.names("_manifest")
        for n in names[:-keep_versions]:
            self.files.remove(f"_manifest/{n}")
        held = {s.name for n in names[-keep_versions:] for s in Manifest.load(self.files.read(f"_manifest/{n}")).segments}
        gone = []
        for run in runs:
            if run in young:
                continue
            files = [f"{run}/{g}/{f}" for g in self.files.names(f"data/{run}") if g.startswith("__group=") for f in self.files.names(f"data/{run}/{g}") if f.endswith(".parquet")]
            dead = [f for f in files if f not in held]
            if len(dead) == len(files):
                self._drop(run)
                gone.append(run)
                continue
            for f in dead:
                self.files.remove(f"data/{f}")
            gone += dead
        return gone

    def export(self, path: str) -> None:
        """The live keys, with the timestamp and applied index that they are as of, for restore()."""
        m = self.manifest()
        read.snapshot(self.log(manifest=m)).select("key", "op", "value").write.parquet(f"{path}/rows")
        Files(self.spark, path).create("state.json", json.dumps({"last_ts": m.last_ts, "applied_index": m.applied_index, "key_type": m.key_type, "value_type": m.value_type}).encode())

    @classmethod
    def restore(cls, spark: SparkSession, root: str, path: str, **kw) -> Store:
        """A new store from what export() wrote; timestamps and applied indexes go on from there."""
        state = json.loads(Files(spark, path).read("state.json"))
        store = cls(spark, root, **kw)
        start = Manifest(0, max(0, state["last_ts"] - 1), state["key_type"], state["value_type"])
        store.files.create("_manifest/00000000000000000000.json", start.dump())
        store.publish(store.stage(spark.read.parquet(f"{path}/rows")), applied_index=state["applied_index"] if state["applied_index"] >= 0 else None)
        return store

    def status(self) -> dict:
        m = self.manifest()
        return {"version": m.version, "last_commit_ts": m.last_ts, "applied_index": m.applied_index, "segments": len(m.segments), "bytes": sum(s.n_bytes for s in m.segments), "rows": sum(s.n_rows for s in m.segments)}

    # ---- transactions

    def begin(self) -> Txn:
        return Txn(self)

    @contextmanager
    def transaction(self):
        """Commit at the end of the block, abort when it raises."""
        t = self.begin()
        try:
            yield t
        except BaseException:
            if not t.finished:
                t.abort()
            raise
        if not t.finished:
            t.commit()

    def execute(self, work: Callable[[Txn], object]):
        with self.transaction() as t:
            return work(t)


class Txn:
    """Snapshot reads at the start timestamp under the transaction's own writes; the first committer of a key wins.
    Reads aren't tracked, so write skew is possible. Single writes are held by the driver, whole tables of them by write()."""

    def __init__(self, store: Store):
        self.store, self.finished = store, False
        self._base = store.manifest()
        self.start_ts = self._base.last_ts
        self._writes: dict[object, tuple[str, object]] = {}
        self._tables: list[DataFrame] = []

    def _alive(self) -> None:
        if self.finished:
            raise FinishedError("the transaction is finished")

    def get(self, key):
        self._alive()
        if key in self._writes:
            op, value = self._writes[key]
            return None if op == DELETE else value
        if self._tables:
            row = self.scan(key, None).where(F.col("key") == F.lit(key)).select("value").first()
            return None if row is None else bytes(row.value) if isinstance(row.value, bytearray) else row.value
        return self.store.get(key, self.start_ts)

    def scan(self, start=None, end=None) -> DataFrame:
        """Keys in [start, end) as this transaction sees them."""
        self._alive()
        base = read.snapshot(self.store.log(start, end, self.start_ts, self._base), self.start_ts)
        own = self._own().withColumn("commit_ts", F.lit(self.start_ts + 1).cast("bigint"))
        return read._bound(read.overlay(base, own.select(*base.columns)), "key", start, end).orderBy("key")

    def put(self, key, value) -> None:
        self._alive()
        self._writes[key] = (PUT, value)

    def delete(self, key) -> None:
        self._alive()
        self._writes[key] = (DELETE, None)

    def write(self, ops: DataFrame) -> None:
        """Buffer a table of operations (key, op, value), later ones over earlier ones; of a key it holds one operation."""
        self._alive()
        if self._writes:
            self._tables.append(self.store._rows([(op, k, v) for k, (op, v) in self._writes.items()]))
            self._writes = {}
        self._tables.append(ops)

    def _own(self) -> DataFrame:
        """All buffered operations, numbered in order."""
        m = self._base
        rows = [(op, k, v) for k, (op, v) in self._writes.items()]
        parts = [*self._tables, *([self.store._rows(rows)] if rows or not self._tables else [])]
        out = None
        for i, t in enumerate(parts):
            one = t.select(F.col("key").cast(m.key_type).alias("key"), "op", F.col("value").cast(m.value_type).alias("value"), F.lit(i).alias("op_seq"))
            out = one if out is None else out.unionByName(one)
        return out

    def commit(self) -> int:
        """The commit timestamp (the start timestamp when nothing was written); raises ConflictError."""
        self._alive()
        self.finished = True
        if not self._writes and not self._tables:
            return self.start_ts
        staged = self.store.stage(self._own(), partitions=None if self._tables else 1)
        if staged is None:
            return self.start_ts
        own = self.store.spark.read.parquet(*[f"{self.store.root}/data/{s.name}" for s in staged.segments]).select("key").withColumn("start_ts", F.lit(self.start_ts))

        def check(m: Manifest) -> None:
            newer = tuple(s for s in m.segments if s.max_ts > self.start_ts and any(s.crosses(o) for o in staged.segments))
            if newer:
                later = self.store.log(manifest=replace(m, segments=newer)).where(F.col("commit_ts") > self.start_ts)
                if read.conflicts(own, later).take(1):
                    self.store._drop(staged.run)
                    raise ConflictError("a key was committed by another transaction")

        return self.store.publish(staged, check)

    def abort(self) -> None:
        self._alive()
        self.finished = True
        self._writes.clear()
        self._tables.clear()
