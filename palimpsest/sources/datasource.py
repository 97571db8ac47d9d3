"""spark.read.format("palimpsest"): the versions of a store, as of a timestamp, for use from SQL.

Options: path (required), read_ts, start and end (keys; hex for binary ones). Each file of the store that can hold a wanted
version is a partition; of it only the columns asked for and the row groups whose statistics allow the bounds are read. With
the option pushdown=true, for which spark.sql.python.filterPushdown.enabled must be set, comparisons of key and commit_ts
with a value are bounds as well. Paths are read with Arrow's file systems. The schema is that of an op-log; put `read.snapshot` or a window over it to get live keys.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str, ts: int | None):
        self.path, self.ts = path, ts


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _compare(left, name: str, right):
    import operator

    return getattr(operator, name)(left, right)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.pushed: list[tuple[str, str, object]] = []  # column, comparison, value
        for option, column, name in (("start", "key", "ge"), ("end", "key", "lt"), ("read_ts", "commit_ts", "le")):
            if option in options:
                self.pushed.append((column, name, self._value(column, options[option])))

    def _value(self, column: str, raw: str):
        kind = self.options["key_kind"] if column == "key" else "bigint"
        return bytes.fromhex(raw) if kind == "binary" else raw if kind == "string" else int(raw)

    def _take(self, filters: list) -> Iterator:
        """Use what filters can be used as bounds; the rest."""
        names = {"EqualTo": "eq", "GreaterThan": "gt", "GreaterThanOrEqual": "ge", "LessThan": "lt", "LessThanOrEqual": "le"}
        for f in filters:
            name, column = names.get(type(f).__name__), getattr(f, "attribute", (None,))
            if name and column in (("key",), ("commit_ts",)) and f.value is not None:
                self.pushed.append((column[0], name, bytes(f.value) if isinstance(f.value, bytearray) else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from palimpsest.sources.store import Manifest

        files, root = _filesystem(self.options["path"])
        least = {"key": ("min_key", "max_key"), "commit_ts": ("min_ts", "max_ts")}

        def may_hold(s) -> bool:
            for column, name, value in self.pushed:
                low, high = (getattr(s, x) for x in least[column])
                if (name in ("eq", "lt", "le") and not _compare(low, "lt" if name == "lt" else "le", value)) or (name in ("eq", "gt", "ge") and not _compare(high, "gt" if name == "gt" else "ge", value)):
                    return False
            return True

        return [_File(f"{root}/data/{s.name}", s.ts) for s in _newest_manifest(files, root, Manifest).segments if may_hold(s)] or [_File("", None)]

    def read(self, partition: _File) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        if not partition.path:
            return
        files, _ = _filesystem(self.options["path"])
        data = ds.dataset(partition.path, format="parquet", filesystem=files)
        wanted = None
        for column, name, value in self.pushed:
            if column == "commit_ts" and partition.ts is not None:
                if not _compare(partition.ts, name, value):
                    return
                continue
            bound = _compare(ds.field(column), name, pa.scalar(value, data.schema.field(column).type))
            wanted = bound if wanted is None else wanted & bound
        columns = {f.name: ds.field(f.name) for f in self.schema.fields}
        if "commit_ts" in columns and partition.ts is not None:
            columns["commit_ts"] = ds.scalar(pa.scalar(partition.ts, pa.int64()))
        for b in data.scanner(columns=columns, filter=wanted, use_threads=False).to_batches():
            if b.num_rows:
                yield b


class _PushingReader(_Reader):
    """Spark refuses a reader with this method unless the session allows it."""

    def pushFilters(self, filters: list) -> Iterator:
        return self._take(filters)


def _newest_manifest(files, root: str, kind):
    from pyarrow import fs as pafs

    names = sorted(x.path for x in files.get_file_info(pafs.FileSelector(f"{root}/_manifest")) if x.path.endswith(".json"))
    with files.open_input_file(names[-1]) as f:
        return kind.load(f.read())


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "palimpsest"

    def schema(self) -> str:
        from palimpsest.sources.store import Manifest

        files, root = _filesystem(self.options["path"])
        m = _newest_manifest(files, root, Manifest)
        return f"key {m.key_type}, commit_ts bigint, op string, value {m.value_type}, op_seq int"

    def reader(self, schema: StructType) -> DataSourceReader:
        from palimpsest.sources.store import Manifest

        files, root = _filesystem(self.options["path"])
        kind = _PushingReader if self.options.get("pushdown", "").lower() == "true" else _Reader
        return kind(dict(self.options) | {"key_kind": _newest_manifest(files, root, Manifest).key_type}, schema)
