"""The apply loop, keyed latest state and leases."""

from datetime import datetime, timedelta

from palimpsest.streaming.apply import apply_batch, apply_log, latest_values, lease_sessions

SCHEMA = "log_index bigint, key binary, op string, value binary"


def test_apply_is_idempotent_on_the_index(spark, store):
    batch = spark.createDataFrame([(0, b"a", "PUT", b"1"), (1, b"a", "PUT", b"2"), (2, b"b", "DELETE", None)], SCHEMA)
    assert apply_batch(store, batch) == 1 and apply_batch(store, batch) is None
    apply_batch(store, spark.createDataFrame([(2, b"b", "PUT", b"no"), (3, b"c", "PUT", b"3")], SCHEMA))
    assert {(bytes(r.key), bytes(r.value)) for r in store.scan().collect()} == {(b"a", b"2"), (b"c", b"3")}


def test_stream_applies_files_once(spark, store, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i * 2, b"k", "PUT", b"%d" % i), (i * 2 + 1, b"k%d" % i, "PUT", b"x")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log")
        apply_log(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.get(b"k") == b"2" and store.manifest().applied_index == 5 and store.scan().count() == 4


def test_latest_values_as_stream_state(spark, tmp_path):
    spark.createDataFrame([(0, b"a", "PUT", b"1"), (1, b"a", "DELETE", None)], SCHEMA).write.parquet(f"{tmp_path}/log")
    q = latest_values(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log")).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.log_index, r.op) for r in spark.sql("select * from latest").collect()] == [(1, "DELETE")]


def test_leases_expire(spark, tmp_path):
    t = datetime(2024, 1, 1)
    beats = [(1, t), (1, t + timedelta(seconds=8)), (1, t + timedelta(seconds=30)), (2, t)]
    df = spark.createDataFrame(beats, "node int, ts timestamp")
    got = {(r.node, (r.expires_at - r.held_from).seconds, r.n_beats) for r in lease_sessions(df, "node", "ts", "10 seconds").collect()}
    assert got == {(1, 18, 2), (1, 10, 1), (2, 10, 1)}
    df.write.parquet(f"{tmp_path}/beats")
    s = lease_sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/beats"), "node", "ts", "10 seconds", "1 second")
    s.writeStream.format("memory").queryName("leases").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select * from leases where node = 1 and n_beats = 2").count() == 1
