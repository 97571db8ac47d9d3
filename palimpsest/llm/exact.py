"""Exact deduplication by a stateful stream over disk-backed keyed state.

Each row's normalised text gives a digest; digests, stable identifiers and content locators (file and row)
are written once and streamed into a keyed aggregation whose RocksDB state never expires. For every digest
the state holds the count and the row to keep with its locator. A digest seen more than once is a hit: once the
stream has drained, each row of a hit is read again and its full normalised bytes are compared with those of
the row to keep, both found by locator. If a digest ever stood for different bytes, its rows are grouped by the
bytes instead.

Equal means identical after deleting space, tab, line feed, vertical tab, form feed and carriage return. Null
counts as empty, and all empty texts are equal. The row with the most code points stays, then the smallest id
(null last), then the first by locator, so of repeated rows exactly one stays. Texts of any length are compared
whole. Empty tables give no rows. Other columns, whatever their names, pass through untouched.
Only DataFrame operations run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.shared import counted, discard, fresh, materialise, write_table
from palimpsest.sources.workspace import workspace

#: Disk-backed state; change logs in place of whole snapshots, and no files preallocated (4 MB a partition otherwise).
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Bytes of digests, identifiers and locators a micro-batch (some 600 million rows).
BATCH = 64 << 30


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, file and row, that name each row for good, and their names; a table that isn't read from
    files is written first."""
    file, row = fresh(docs, "__locator_file"), fresh(docs, "__locator_row")

    def name(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.select("*", at["file_path"].alias(file), at["row_index"].alias(row))

    try:
        return name(docs), file, row
    except AnalysisException:
        return name(materialise(docs, "located")), file, row


def _candidate(id_col: str = "id") -> Column:
    """Orders the rows of a group; the least stays."""
    return F.struct((-F.col("n_points")).alias("less"), F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("file"), F.col("row"))


def _through_state(prints: DataFrame, source: str, digest: Column, bytes_per_batch: int | None) -> DataFrame:
    """Stream the table of prints at source through keyed state and read the state back: digest, keep, group_size."""
    spark = prints.sparkSession
    held, path = {k: spark.conf.get(k, None) for k in _STATE_CONF}, workspace(spark, "exact-state")
    reader = spark.readStream.schema(prints.schema)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", str(bytes_per_batch))
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        states = reader.parquet(source).groupBy(digest.alias("digest")).agg(F.min(_candidate()).alias("keep"), F.count("*").alias("group_size"))
        states.writeStream.format("noop").outputMode("update").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(path)
        key, value = (state.schema[k].dataType.fieldNames() for k in ("key", "value"))
        return materialise(state.select(F.col(f"key.`{key[0]}`").alias("digest"), F.col(f"value.`{value[0]}`").alias("keep"), F.col(f"value.`{value[1]}`").alias("group_size")), "exact-groups", short=True)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_of: Callable[[Column], Column] = lambda sha: sha, bytes_per_batch: int | None = BATCH) -> DataFrame:
    """One row per row of docs: id, file, row (its locator), text_sha256, keep_id, group_size and kept.

    digest_of maps the hex SHA-256 to the state's key and may be weak: hits are settled on full bytes.
    """
    return _groups(*located(docs), id_col, text_col, digest_of, bytes_per_batch)


def _groups(src: DataFrame, file: str, row: str, id_col: str, text_col: str, digest_of: Callable[[Column], Column], bytes_per_batch: int | None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    at = [F.col(file).alias("file"), F.col(row).alias("row")]
    named = src.select(F.col(f"`{id_col}`").alias("id"), *at, F.sha2(normalise(text), 256).alias("text_sha256"), F.length(F.coalesce(text, F.lit(""))).alias("n_points"))
    source = write_table(named, "exact-prints")
    prints = src.sparkSession.read.schema(named.schema).parquet(source)
    found = _through_state(prints, source, digest_of(F.col("text_sha256")), bytes_per_batch)

    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    rows = prints.withColumn("digest", digest_of(F.col("text_sha256"))).join(found, "digest").withColumn("kept", kept)
    hits, some = counted(rows.where("group_size > 1").select(F.xxhash64("file").alias("f"), "file", "row", "digest", "kept"), "exact-hits", short=True)
    mixed, split = None, 0
    if some:
        norm = normalise(text).alias("norm")
        # by shuffle at every size: hits grow with the corpus, so broadcasting them would only serve small ones
        read_again = src.select(F.xxhash64(F.col(file)).alias("f"), *at, norm).join(hits.hint("merge"), ["f", "file", "row"])
        texts = materialise(read_again.select("digest", "kept", "norm"), "exact-texts")
        held = texts.where("kept").select("digest", F.col("norm").alias("kept_norm"))
        # not made distinct here: a join alone lets a hot digest be split
        mixed, split = counted(texts.where("not kept").join(held, "digest").where("norm <> kept_norm").select("digest"), "exact-mixed", short=True)
        mixed = mixed.distinct()
        discard(hits, texts)
    if split:
        bytes_of = src.select(*at, normalise(text).alias("norm"))
        apart = rows.join(mixed, "digest").drop("keep", "group_size", "kept").join(bytes_of, ["file", "row"])
        best = apart.groupBy("digest", "norm").agg(F.min(_candidate()).alias("keep"), F.count("*").alias("group_size"))
        apart = apart.join(best, ["digest", "norm"]).drop("norm").withColumn("kept", kept)
        rows = rows.join(mixed, "digest", "left_anti").unionByName(apart)
    return rows.select("id", "file", "row", "text_sha256", F.col("keep.id").alias("keep_id"), "group_size", "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_batch: int | None = BATCH) -> DataFrame:
    """docs without the rows that are copies of one that stays; same columns."""
    src, file, row = located(docs)
    keep = _groups(src, file, row, id_col, text_col, lambda sha: sha, bytes_per_batch).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    return src.join(keep, [file, row], "left_semi").drop(file, row)


def groups_query(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    return groups(docs.select("doc_id", "text")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


GROUPS_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256,
    row_number() over (order by doc_id) as r from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  first_value(r) over w = r as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id, r)
"""
