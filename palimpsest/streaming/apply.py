"""Structured Streaming over a replicated log and over heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import read
from palimpsest.sources.store import Store


def apply_batch(store: Store, entries: DataFrame) -> int | None:
    """Apply log entries (log_index, key, op, value) once: indexes at or below the store's applied index are skipped, and the
    index advances in the same manifest as the data, so a repeated batch changes nothing."""
    done = store.manifest().applied_index
    fresh = entries.where(F.col("log_index") > done)
    top = fresh.agg(F.max("log_index")).first()[0]
    if top is None:
        return None
    # of each key the entry of the greatest index; indexes may lie any distance apart, so they can't be numbers inside a batch
    ordered = read.latest(fresh.select("key", "op", "value", F.col("log_index").alias("__at")), ["key"], ["__at"])
    return store.publish(store.stage(ordered), applied_index=top)


def apply_log(entries: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run the apply loop over a stream of log entries; each micro-batch is one commit."""
    writer = entries.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_values(entries: DataFrame) -> DataFrame:
    """The newest operation of every key as keyed streaming state."""
    return entries.groupBy("key").agg(F.max_by(F.struct("log_index", "op", "value"), "log_index").alias("v")).select("key", "v.*")


def lease_sessions(beats: DataFrame, node: str, ts: str, timeout: str, late: str | None = None) -> DataFrame:
    """Stretches during which a node's lease held: heartbeats no further apart than the timeout. On a stream give `late`,
    the watermark's delay; a session comes out once it can't grow any more."""
    if late:
        beats = beats.withWatermark(ts, late)
    w = F.session_window(ts, timeout)
    return beats.groupBy(F.col(node), w.alias("w")).agg(F.count("*").alias("n_beats")).select(node, F.col("w.start").alias("held_from"), F.col("w.end").alias("expires_at"), "n_beats")
