"""File layout: block and file indexes, overlap, splitting, compaction merge and version collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.codec import record_crc, shared_prefix
from palimpsest.model import DELETE, STANDARD, Columns
from palimpsest.operators import read
from palimpsest.sources.workspace import workspace


def cut_by_size(df: DataFrame, order: list[str], size: Column, limit: int, within: list[str] | None = None, out: str = "block") -> DataFrame:
    """Number stretches of about `limit` bytes in key order by the running size divided by limit.

    Fixed-width cuts, unlike a greedy cut, need only prefix sums. Without `within`, rows are range-partitioned
    first and each range starts from the total of the ranges before it, so no single task sees all rows.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.floor((F.sum(size).over(w) - size) / limit).cast("bigint"))
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__part", F.spark_partition_id())
    # the ranges are sampled alike each time, but a table written once doesn't depend on that, nor on the memory of executors
    path = workspace(spark, "ranges")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    totals = sorted((r["__part"], r["t"] or 0) for r in dealt.groupBy("__part").agg(F.sum(size).alias("t")).collect())
    bases, at = [], 0
    for part, total in totals:
        bases.append((part, at))
        at += total
    # one row a range, of which there are as many as shuffle partitions
    start = F.broadcast(spark.createDataFrame(bases or [(0, 0)], "__part int, __base bigint"))
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(start, "__part").withColumn(out, F.floor((F.col("__base") + F.sum(size).over(w) - size) / limit).cast("bigint")).drop("__part", "__base")


def block_index(df: DataFrame, key: str, size: Column, limit: int = 4096) -> DataFrame:
    """Per block: least and greatest key, rows and bytes."""
    cut = cut_by_size(df.withColumn("__size", size), [key], F.col("__size"), limit)
    return cut.groupBy("block").agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("n_rows"), F.sum("__size").cast("bigint").alias("n_bytes"))


def prefix_compressed(df: DataFrame, key: str, restart: int = 16, within: str | None = None) -> DataFrame:
    """Each key's shared prefix with the key before it, 0 at every restart point. Without `within`, keys are dealt into ranges,
    as they are into files, and every range starts anew."""
    if within is None:
        spark = df.sparkSession
        df = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("__range", F.spark_partition_id())
    w = Window.partitionBy(within or "__range").orderBy(key)
    place = F.row_number().over(w) - 1
    shared = F.when(place % restart == 0, 0).otherwise(shared_prefix(F.lag(key).over(w).cast("binary"), F.col(key).cast("binary")))
    return df.withColumn("shared_len", shared).drop("__range")


def overlapping(files: DataFrame, intervals: DataFrame) -> DataFrame:
    """files (min_key, max_key) crossed by half-open [start, end); a null side is open. Both are manifest-sized."""
    hit = (F.col("start").isNull() | (F.col("max_key") >= F.col("start"))) & (F.col("end").isNull() | (F.col("min_key") < F.col("end")))
    return files.join(intervals, hit)


def collect_versions(log: DataFrame, watermark: int, c: Columns = STANDARD) -> DataFrame:
    """Versions that a read at or after the watermark may need: all newer ones, and the newest at the watermark if live."""
    newer = log.where(F.col(c.ts) > watermark)
    at = read.newest(log, watermark, c)
    return newer.unionByName(at.where(F.col(c.op) != DELETE).select(*log.columns))


def compact(log: DataFrame, partitions: int, c: Columns = STANDARD) -> DataFrame:
    """Versions merged without duplicates (same key, timestamp and order), range-partitioned and sorted by key, newest first."""
    merged = log.dropDuplicates([c.key, c.ts, *[x for x in ("op_seq",) if x in log.columns]])
    return merged.repartitionByRange(partitions, c.key).sortWithinPartitions(F.asc(c.key), F.desc(c.ts))


def recover(records: DataFrame, file: str = "file", seq: str = "seq", crc: str = "crc") -> DataFrame:
    """The records (op, key, value binary) to replay: of each file those before its first record whose checksum fails."""
    bad = record_crc(F.col("op"), F.col("key"), F.col("value")) != F.col(crc)
    stops = records.where(bad | F.col(crc).isNull()).groupBy(file).agg(F.min(seq).alias("__stop"))
    return records.join(stops, file, "left").where(F.col("__stop").isNull() | (F.col(seq) < F.col("__stop"))).drop("__stop")


def manifest_after(manifest: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The file set once inputs are replaced by outputs."""
    return manifest.join(inputs.select("file"), "file", "left_anti").unionByName(outputs)
