"""Reads, merges and layout operators against small models."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import maintenance, read, replication

LOG = "key string, commit_ts bigint, op string, value string"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_tombstones_hide_only_after_newest_wins(spark):
    log = log_of(spark, [("a", 1, "PUT", "x"), ("a", 2, "DELETE", None), ("b", 1, "PUT", "")])
    assert [(r.key, r.value) for r in read.snapshot(log).collect()] == [("b", "")]
    assert {r.key for r in read.snapshot(log, 1).collect()} == {"a", "b"}
    assert [r.key for r in read.deleted_keys(log).collect()] == ["a"] and read.snapshot(log, 0).count() == 0


def test_prefix_scan_and_seek(spark):
    log = log_of(spark, [(k, 1, "PUT", k) for k in ("a", "ab", "abc", "b", "user:1", "user:2")])
    assert [r.key for r in read.prefix_scan(log, "ab").collect()] == ["ab", "abc"]
    assert [r.key for r in read.seek(log, "abc", 2).collect()] == ["abc", "b"]
    assert read.prefix_range(b"a\xff") == (b"a\xff", b"b") and read.prefix_range(b"\xff") == (b"\xff", None)


def test_multi_get_reports_every_key(spark):
    log = log_of(spark, [("a", 1, "PUT", "x"), ("b", 1, "DELETE", None)])
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    assert {(r.key, r.value, r.found) for r in read.multi_get(log, keys).collect()} == {("a", "x", True), ("b", None, False), ("c", None, False)}


def test_merge_prefers_the_first_source(spark):
    new, old = log_of(spark, [("a", 1, "DELETE", None), ("b", 1, "PUT", "new")]), log_of(spark, [("a", 9, "PUT", "old"), ("c", 9, "PUT", "c")])
    assert {(r.key, r.value) for r in read.merge_newest_wins([new, old]).collect()} == {("b", "new"), ("c", "c")}


def test_overlay(spark):
    base = read.snapshot(log_of(spark, [("a", 1, "PUT", "1"), ("b", 1, "PUT", "2")]))
    own = log_of(spark, [("a", 2, "DELETE", None), ("c", 2, "PUT", "3")])
    assert {(r.key, r.value) for r in read.overlay(base, own).collect()} == {("b", "2"), ("c", "3")}


def test_asof_random(spark):
    rng = random.Random(4)
    log = [(rng.choice("abc"), t, rng.choice(["PUT", "DELETE"]), str(t)) for t in range(60)]
    probes = [(i, rng.choice("abcd"), rng.randint(0, 70)) for i in range(80)]
    want = {(i, max((t for k2, t, _, _ in log if k2 == k and t <= at), default=None)) for i, k, at in probes}
    df = spark.createDataFrame(probes, "id int, key string, at bigint")
    for span in (None, 7):
        assert {(r.id, r.commit_ts) for r in read.asof(df, log_of(spark, log), span=span).collect()} == want


def test_conflicts_see_tombstones(spark):
    log = log_of(spark, [("a", 5, "DELETE", None), ("b", 3, "PUT", "x")])
    writes = spark.createDataFrame([("a", 4), ("b", 3), ("c", 0)], "key string, start_ts bigint")
    assert [r.key for r in read.conflicts(writes, log).collect()] == ["a"]


def test_codec_round_trip_and_order(spark):
    df = spark.createDataFrame([("mykey", 100), ("mykey", 200), ("", 0), ("k", 2**62)], "k string, t bigint")
    e = codec.encode_version(F.col("k"), F.col("t"))
    back = df.select("k", "t", F.hex(e).alias("h"), codec.to_text(codec.decode_key(e)).alias("k2"), codec.decode_ts(e).alias("t2")).collect()
    assert all((r.k, r.t) == (r.k2, r.t2) for r in back)
    assert back[0].h == "6D796B6579FFFFFFFFFFFFFF9B" and back[1].h < back[0].h
    short = df.select(codec.decode_ts(F.lit("abc").cast("binary")).alias("x")).first()
    assert short.x is None


def test_hashes(spark):
    def fnv(b):
        h = 2166136261
        for x in b:
            h = ((h ^ x) * 16777619) & 0xFFFFFFFF
        return h

    data = [b"", b"a", b"\xff\x80\x00", b"hello world"]
    df = spark.createDataFrame([(bytearray(x),) for x in data], "d binary")
    got = df.select(codec.fnv1a(F.col("d")).alias("h"), codec.shared_prefix(F.col("d"), F.lit(bytearray(b"hex"))).alias("p")).collect()
    assert [r.h for r in got] == [fnv(x) for x in data] and [r.p for r in got] == [0, 0, 0, 2]


def test_blocks_and_versions(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "k bigint")
    blocks = maintenance.block_index(df, "k", F.lit(10), 95).orderBy("block").collect()
    assert sum(b.n_rows for b in blocks) == 1000 and all(b.n_bytes <= 100 for b in blocks)
    assert all(x.max_key < y.min_key for x, y in zip(blocks, blocks[1:]))
    log = log_of(spark, [("a", 1, "PUT", "1"), ("a", 2, "PUT", "2"), ("a", 5, "PUT", "5"), ("b", 2, "DELETE", None)])
    assert {(r.key, r.commit_ts) for r in maintenance.collect_versions(log, 3).collect()} == {("a", 2), ("a", 5)}


def test_replication(spark):
    acks = spark.createDataFrame([(0, 9), (1, 7), (2, 7), (3, 2), (4, 1), (4, 3)], "peer_id int, match_index bigint")
    assert replication.commit_index(acks).first().asDict() == {"majority_index": 7, "all_index": 2}
    assert replication.wait_for(acks, 7, 3).first().asDict() == {"n_acks": 3, "ok": True}
    log = spark.createDataFrame([(7, 1)], "log_index bigint, term bigint")
    assert not replication.commit_index(acks, 2, log).first().commits
    votes = spark.createDataFrame([(1, 0, 0, True), (1, 0, 0, True), (1, 0, 1, False)], "term int, candidate int, voter int, granted boolean")
    assert replication.vote_tally(votes, 3).first().n_votes == 1 and not replication.vote_tally(votes, 3).first().elected


def test_peers(spark):
    df = spark.createDataFrame([("1:host:7001, 2:h2:7002,bad,3:x", "h2:7002", 7105)], "s string, a string, p int")
    r = df.select(codec.parse_peers(F.col("s")).alias("peers"), codec.node_id(codec.parse_peers(F.col("s")), F.col("a"), F.col("p")).alias("mine"), codec.node_id(codec.parse_peers(F.col("s")), F.lit("?"), F.col("p")).alias("other")).first()
    assert [(x.id, x.address) for x in r.peers] == [(1, "host:7001"), (2, "h2:7002")] and (r.mine, r.other) == (2, 5)


def test_key_range_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    log = log_of(spark, [(f"k{i}", 1, "PUT", "x") for i in range(10)])
    log.write.parquet(f"{tmp_path}/log")
    df = read.scan(spark.read.parquet(f"{tmp_path}/log"), "k3", "k7", read_ts=5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,k3)" in plan and "LessThan(key,k7)" in plan and "LessThanOrEqual(commit_ts,5)" in plan


def test_fixed_width_versions_are_hashed_not_sorted(spark):
    log = spark.createDataFrame([(k, t, "DELETE" if t % 3 == 0 else "PUT", None if t % 3 == 0 else t / 2, s) for k in range(5) for t in range(k, 9) for s in (0, 1)], "key bigint, commit_ts bigint, op string, value double, op_seq int")
    for df in (log, log.drop("op_seq")):
        found = read.newest(df, 7)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
        assert {(r.key, r.commit_ts, r.op, r.value) for r in found.collect()} == {(k, 7, "PUT", 3.5) for k in range(5)}
    plain = read.newest(log.withColumn("value", F.col("value").cast("string")), 6)
    assert {(r.key, r.commit_ts, r.op, r.value, r.op_seq) for r in plain.collect()} == {(k, 6, "DELETE", None, 1) for k in range(5)}
    merged = read.merge_newest_wins([log.where("commit_ts < 5").drop("op_seq"), log.drop("op_seq")])
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.commit_ts) for r in merged.collect()} == {(k, 4) for k in range(5)}


def test_order_of_two_numbers_keeps_extremes(spark):
    rows = [("a", t, "PUT", 1.0 * i, s) for i, (t, s) in enumerate([(-(2**62), 2**31 - 1), (2**62, -(2**31)), (2**62, 5), (2**62, -7), (0, 0)])]
    log = spark.createDataFrame(rows, "key string, commit_ts bigint, op string, value double, op_seq int")
    assert [(r.commit_ts, r.op_seq) for r in read.newest(log).collect()] == [(2**62, 5)]
