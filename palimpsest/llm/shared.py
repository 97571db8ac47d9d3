"""Helpers shared by the training-data operators: work tables in the cluster's shared folder, columns made in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from palimpsest.sources.workspace import workspace


#: Tables of short rows are written by so many times fewer tasks than a shuffle has, which is laid out for texts.
SHORT_ROWS = 8


def write_table(df: DataFrame, tag: str, codec: str = "zstd", short: bool = False) -> str:
    """Write df once to the shared folder; its path. short: rows are short, so that fewer files will do."""
    path = workspace(df.sparkSession, tag)
    if short:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHORT_ROWS))
    df.write.option("compression", codec).parquet(path)
    return path


def materialise(df: DataFrame, tag: str, codec: str = "zstd", short: bool = False) -> DataFrame:
    """df written once and read back: lineage ends there and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag, codec, short))


def counted(df: DataFrame, tag: str, which: Column | None = None, short: bool = False) -> tuple[DataFrame, int]:
    """materialise(df) and the number of its rows (of those where `which` holds), counted as they are written.

    A task that runs twice may count its rows twice, so the number is only good for telling none from some.
    """
    seen = Observation()
    out = materialise(df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")), tag, short=short)
    return out, seen.get.get("n") or 0


def discard(*tables: DataFrame) -> None:
    """Delete work tables that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of an Arrow batch sent to Python at once; a longer row travels alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, since texts may be long; a bound that the session already has is kept.

    The setting stays, for plans read it when they run.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def append_columns(df: DataFrame, source: str, made: Callable[[list], list[pa.Array]], columns: list[tuple[str, str]], drop_source: bool = False) -> DataFrame:
    """df with columns (name, Spark type) that made() gives for each Arrow batch of the source column's values.

    The other columns pass through untouched; those already called like a new one, as the session compares names, are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    fold = str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    names = [n for n, _ in columns]
    gone = {fold(n) for n in names} | ({fold(source)} if drop_source else set())
    kept = [f for f in df.schema.fields if fold(f.name) not in gone]
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias(fresh(df, "__source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made(b.column(b.num_columns - 1).to_pylist())], names=[*b.schema.names[:-1], *names])

    return src.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*((f.name, f.dataType.simpleString()) for f in kept), *columns]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
