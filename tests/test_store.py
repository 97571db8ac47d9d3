"""The store against the behaviour of an ordered map, before and after flush, compaction and reopening."""

import random

import pytest

from palimpsest.cli import run_command
from palimpsest.sources.files import AlreadyThere
from palimpsest.sources.store import ConflictError, FinishedError, Store


def rows(df):
    return [(bytes(r.key), None if r.value is None else bytes(r.value)) for r in df.collect()]


def test_put_overwrite_delete(store):
    store.write_rows([("PUT", b"key1", b"v1"), ("PUT", b"key1", b"v2"), ("PUT", b"key2", b"x")])
    assert store.get(b"key1") == b"v2"
    store.delete(b"key1")
    assert store.get(b"key1") is None and store.get(b"key2") == b"x" and store.get(b"nothing") is None


def test_delete_of_missing_key_is_an_entry(store):
    store.delete(b"nonexistent")
    assert rows(store.scan()) == []
    assert rows(store.scan(tombstones=True)) == [(b"nonexistent", None)]


def test_batch_last_operation_wins(store):
    store.write_rows([("PUT", b"k1", b"1"), ("PUT", b"k2", b"2"), ("PUT", b"k3", b"3"), ("DELETE", b"k1", None)])
    assert rows(store.scan()) == [(b"k2", b"2"), (b"k3", b"3")]


@pytest.mark.parametrize("compacted", [False, True])
def test_ranges(store, compacted):
    store.write_rows([("PUT", b"key%03d" % i, b"v%d" % i) for i in range(10)])
    if compacted:
        store.compact()
    assert [k for k, _ in rows(store.scan(b"key003", b"key007"))] == [b"key%03d" % i for i in range(3, 7)]
    assert len(rows(store.scan(b"key008"))) == 2 and len(rows(store.scan(None, b"key002"))) == 2
    assert rows(store.scan(b"key7", b"key5")) == [] and rows(store.scan(b"key003", b"key003")) == []
    assert len(rows(store.scan(limit=4))) == 4 and len(rows(store.scan(limit=0))) == 10


@pytest.mark.parametrize("compacted", [False, True])
def test_bytes_order_empty_key_and_empty_value(store, compacted):
    keys = [b"", b"a", b"ab", b"b", b"\x7f", b"\x80", b"\xff"]
    store.write_rows([("PUT", k, b"") for k in reversed(keys)])
    if compacted:
        store.compact()
    assert rows(store.scan()) == [(k, b"") for k in keys]
    assert store.get(b"") == b""  # an empty value is no tombstone
    assert [k for k, _ in rows(store.scan(b"a", b"ab"))] == [b"a"]


def test_large_value(store):
    big = bytes(i % 256 for i in range(10240))
    store.put(b"big", big)
    assert store.get(b"big") == big


def test_time_travel_and_versions(store):
    t1 = store.put(b"k", b"1")
    t2 = store.delete(b"k")
    t3 = store.put(b"k", b"3")
    store.compact()
    assert [store.get(b"k", t) for t in (0, t1, t2, t3)] == [None, b"1", None, b"3"]
    assert store.log().count() == 3


def test_timestamps_continue_after_reopening(spark, store):
    t = store.put(b"k", b"1")
    again = Store(spark, store.root)
    assert again.get(b"k") == b"1" and again.put(b"k", b"2") == t + 1 and store.get(b"k") == b"2"


def test_compaction_merges_and_garbage_goes(store):
    for i in range(5):
        store.write_rows([("PUT", b"a", b"%d" % i), ("DELETE" if i == 3 else "PUT", b"b", b"x")])
    before = rows(store.scan())
    store.compact()
    assert rows(store.scan()) == before and [s.level for s in store.manifest().segments] == [1]
    at4 = rows(store.scan(read_ts=4))
    store.collect_garbage(4)
    assert rows(store.scan(read_ts=4)) == at4 == [(b"a", b"3")] and store.log().count() == 3
    assert store.vacuum() and rows(store.scan()) == before


def test_levels_merge_only_what_overlaps(store):
    store.write_rows([("PUT", b"a1", b"x"), ("PUT", b"a9", b"x")])
    store.compact()
    store.write_rows([("PUT", b"z1", b"x")])
    store.compact()
    assert len(store.manifest().segments) == 2
    store.write_rows([("PUT", b"a5", b"y")])
    store.compact()
    assert sorted(s.n_rows for s in store.manifest().segments) == [1, 3]


def test_compaction_starts_by_itself(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/auto", l0_trigger=3, target_partitions=1)
    for i in range(3):
        s.put(b"k%d" % i, b"v")
    assert [x.level for x in s.manifest().segments] == [1] and len(rows(s.scan())) == 3


def test_vacuum_spares_what_is_staged(store):
    store.put(b"a", b"1")
    staged = store.stage(store._rows([("PUT", b"b", b"2")]))
    assert store.vacuum() == []
    store.publish(staged)
    assert rows(store.scan()) == [(b"a", b"1"), (b"b", b"2")]
    dead = store.stage(store._rows([("PUT", b"c", b"3")]))
    assert store.vacuum(staged_seconds=0) == [dead.run]
    with pytest.raises(FileNotFoundError):
        store.publish(dead)
    assert rows(store.scan()) == [(b"a", b"1"), (b"b", b"2")] and store.vacuum(staged_seconds=0) == []


def test_failed_compaction_leaves_the_commit(spark, tmp_path, monkeypatch):
    s = Store.create(spark, f"file://{tmp_path}/failing", l0_trigger=2, target_partitions=1)
    s.put(b"a", b"1")
    monkeypatch.setattr(s, "compact", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.warns(RuntimeWarning, match="disk"):
        assert s.put(b"b", b"2") == 2
    assert s.get(b"b") == b"2"


def test_level_one_files_are_cut_by_size_and_rewritten_where_they_overlap(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/sized", "bigint", "string", l0_trigger=100, target_partitions=4, target_bytes=4096)
    rng = random.Random(1)
    s.write(spark.createDataFrame([(k, "PUT", str(rng.random())) for k in range(3000)], "key bigint, op string, value string"))
    s.compact()
    before = s.manifest().segments
    assert len(before) > 4 and all(a.max_key < b.min_key for a, b in zip(sorted(before, key=lambda x: x.min_key), sorted(before, key=lambda x: x.min_key)[1:]))
    s.write_rows([("PUT", 5, "low"), ("PUT", 6, "low")])
    s.write_rows([("PUT", 2990, "high")])
    s.compact()
    after = s.manifest().segments
    kept = {x.name for x in before} & {x.name for x in after}
    assert len(kept) >= len(before) - 3 and all(x.level == 1 for x in after)
    order = sorted(after, key=lambda x: x.min_key)
    assert all(a.max_key < b.min_key for a, b in zip(order, order[1:]))  # also none spans a file that stayed
    got = {r.key: r.value for r in s.snapshot().collect()}
    assert len(got) == 3000 and (got[5], got[6], got[2990]) == ("low", "low", "high")
    gone = s.vacuum()
    assert gone and {r.key: r.value for r in s.snapshot().collect()} == got


def test_files_carry_key_filters_and_statistics(spark, store):
    store.write_rows([("PUT", b"k%03d" % i, b"v") for i in range(0, 200, 2)])
    (segment,) = store.manifest().segments
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{store.root}/data/{segment.name}")
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    try:
        block = reader.getFooter().getBlocks()[0]
        column = next(c for c in block.getColumns() if c.getPath().toDotString() == "key")
        bloom = reader.getBloomFilterDataReader(block).readBloomFilter(column)
        held = lambda k: bloom.findHash(bloom.hash(jvm.org.apache.parquet.io.api.Binary.fromConstantByteArray(k)))
        assert all(held(b"k%03d" % i) for i in range(0, 200, 2)) and sum(held(b"k%03d" % i) for i in range(1, 200, 2)) < 20
        assert bytes(column.getStatistics().getMinBytes()) == segment.min_key == b"k000" and bytes(column.getStatistics().getMaxBytes()) == b"k198"
    finally:
        reader.close()


def test_small_batches_are_one_file(store):
    store.put(b"a", b"1")
    assert len(store.manifest().segments) == 1
    plan = store.log()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_writers_wait_while_many_batches_are_unmerged(spark, tmp_path):
    s = Store.create(spark, f"file://{tmp_path}/stop", l0_trigger=100, l0_stop=3, target_partitions=1)
    for i in range(7):
        s.put(b"k%d" % i, b"v")
        assert len([x for x in s.manifest().segments if x.level == 0]) <= 3
    assert s.scan().count() == 7


def test_writes_wait_for_replicas(spark, store):
    batch = store._rows([("PUT", b"a", b"1")])
    acks = lambda *at: lambda: spark.createDataFrame(list(enumerate(at)), "peer_id int, match_index bigint")
    assert store.write(batch, replicas=2, acks=acks(1, 1, 0)) == 1
    with pytest.raises(TimeoutError):
        store.write(batch, replicas=2, acks=acks(2, 1, 0), timeout=0.1)
    assert store.manifest().last_ts == 2


def test_export_and_restore(spark, store, tmp_path):
    store.write_rows([("PUT", b"a", b"1"), ("PUT", b"b", b"2")])
    store.delete(b"a")
    store.export(f"file://{tmp_path}/out")
    again = Store.restore(spark, f"file://{tmp_path}/again", f"file://{tmp_path}/out")
    assert rows(again.scan()) == [(b"b", b"2")] and again.put(b"c", b"3") == store.manifest().last_ts + 1


def test_tables_in_transactions(spark, store):
    table = lambda n, v: spark.createDataFrame([(b"k%d" % i, "PUT", v) for i in range(n)], "key binary, op string, value binary")
    one, two, three = store.begin(), store.begin(), store.begin()
    one.put(b"k1", b"first")
    one.write(table(3, b"x"))
    one.delete(b"k2")
    assert one.get(b"k1") == b"x" and one.get(b"k2") is None and one.scan().count() == 2
    two.write(table(2, b"y"))
    three.write(spark.createDataFrame([(b"other", "PUT", b"z")], table(0, b"").schema))
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    three.commit()
    assert rows(store.scan()) == [(b"k0", b"x"), (b"k1", b"x"), (b"other", b"z")]


def test_manifest_is_created_once(store):
    store.put(b"a", b"1")
    with pytest.raises(AlreadyThere):
        store.files.create("_manifest/00000000000000000001.json", b"{}")


def test_null_keys_are_refused(store):
    with pytest.raises(ValueError):
        store.write_rows([("PUT", None, b"x")])


def test_readers_keep_their_snapshot_while_compacting(store):
    store.put(b"a", b"1")
    df = store.snapshot()
    store.put(b"a", b"2")
    store.compact()
    assert rows(df) == [(b"a", b"1")]


def test_transactions(store):
    with store.transaction() as t:
        t.put(b"a", b"1")
        t.put(b"b", b"2")
        assert t.get(b"a") == b"1" and store.get(b"a") is None
    with store.transaction() as t:
        t.put(b"b", b"22")
        t.put(b"c", b"3")
    with store.transaction() as t:
        t.delete(b"a")
        assert t.get(b"a") is None
        t.put(b"c", b"33")
        assert [bytes(r.key) for r in t.scan().collect()] == [b"b", b"c"]
    assert rows(store.scan()) == [(b"b", b"22"), (b"c", b"33")]


def test_first_committer_wins_also_for_tombstones(store):
    store.put(b"k", b"0")
    one, two = store.begin(), store.begin()
    one.delete(b"k")
    two.put(b"k", b"2")
    other = store.begin()
    other.put(b"free", b"1")
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    other.commit()
    assert store.get(b"k") is None and store.get(b"free") == b"1"


def test_reads_stay_at_the_start(store):
    store.put(b"k", b"old")
    t = store.begin()
    store.put(b"k", b"new")
    assert t.get(b"k") == b"old"
    t.abort()
    for use in (lambda: t.get(b"k"), lambda: t.put(b"k", b"x"), t.commit, t.abort):
        with pytest.raises(FinishedError):
            use()


def test_failed_block_aborts(store):
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.put(b"k", b"x")
        raise RuntimeError
    assert store.get(b"k") is None and store.execute(lambda t: 5) == 5


def test_random_operations_against_a_model(spark, tmp_path):
    rng = random.Random(11)
    store = Store.create(spark, f"file://{tmp_path}/model", "string", "string", l0_trigger=100, target_partitions=2)
    model: dict[int, dict] = {0: {}}
    for step in range(1, 9):
        state, ops = dict(model[step - 1]), []
        for _ in range(rng.randint(1, 12)):
            k = rng.choice(["", "a", "ab", "abc", "b", "ba", "z"])
            if rng.random() < 0.35:
                ops.append(("DELETE", k, None))
                state.pop(k, None)
            else:
                v = str(rng.random())
                ops.append(("PUT", k, v))
                state[k] = v
        assert store.write_rows(ops) == step
        model[step] = state
        if step in (3, 6):
            store.compact()
    for ts, state in model.items():
        assert {r.key: r.value for r in store.snapshot(ts).collect()} == state
    got = store.scan("a", "b", read_ts=7).collect()
    assert [(r.key, r.value) for r in got] == sorted((k, v) for k, v in model[7].items() if "a" <= k < "b")


def test_data_source_reads_as_of(spark, store):
    from palimpsest.sources.datasource import StoreSource

    store.write_rows([("PUT", b"a", b"1"), ("PUT", b"b", b"2")])
    store.put(b"a", b"3")
    spark.dataSource.register(StoreSource)
    path = store.root.removeprefix("file://")
    assert spark.read.format("palimpsest").option("path", path).load().count() == 3
    old = spark.read.format("palimpsest").option("path", path).option("read_ts", "1").option("start", b"b".hex()).load()
    assert [(bytes(r.key), r.commit_ts, bytes(r.value)) for r in old.collect()] == [(b"b", 1, b"2")]


def test_data_source_reads_what_is_asked_for(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.sources import datasource

    s = Store.create(spark, f"file://{tmp_path}/pushed", "string", "string", l0_trigger=100, target_partitions=2, target_bytes=20_000)
    s.write(spark.createDataFrame([(f"k{i:05d}", "PUT", str(i * 7919)) for i in range(4000)], "key string, op string, value string"))
    s.compact()
    s.put("k00001", "new")
    assert len(s.manifest().segments) > 3
    spark.dataSource.register(datasource.StoreSource)
    load = lambda **o: spark.read.format("palimpsest").options(path=f"{tmp_path}/pushed", **o).load()
    assert load().count() == 4001 and load(start="k01000", end="k01010").count() == 10
    for o in ({}, {"pushdown": "true"}):
        if o:
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        some = load(**o).where((F.col("key") >= "k00001") & (F.col("key") < "k00003")).select("value")
        assert sorted(r.value for r in some.collect()) == sorted(["7919", "new", str(2 * 7919)])
        assert load(**o).where("commit_ts > 1").count() == 1 and load(**o).where("commit_ts = 1 and key = 'k00001'").first().value == "7919"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = datasource._Reader({"path": f"{tmp_path}/pushed", "key_kind": "string", "start": "k03990"}, load().schema)
    assert len(reader.partitions()) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10


def test_view(spark, store):
    store.put(b"a", b"1")
    store.create_view("kv")
    assert spark.sql("select count(*) from kv").first()[0] == 1


def test_commands(store):
    for k, v in (("user:1:name", "Alice"), ("user:1:age", "30"), ("user:2:name", "Bob Jr")):
        assert run_command(store, f"put {k} {v}") == "OK"
    assert run_command(store, "GET user:2:name") == "Bob Jr"
    assert run_command(store, "scan user:1 user:2").splitlines()[-1] == "(2 entries)"
    assert run_command(store, "delete user:1:age") == "OK" and run_command(store, "get user:1:age") == "(nil)"
    assert "version" in run_command(store, "info") and "put KEY" in run_command(store, "what") and run_command(store, "exit") is None


def test_query_stores_the_whole_log(spark, tmp_path, monkeypatch):
    from palimpsest.plans import catalogue

    made, create = [], Store.create
    monkeypatch.setattr(Store, "create", lambda *a, **k: made.append(create(*a, **k)) or made[-1])
    kinds = ["click", "error", "view"]
    events = [(i, i * 7 % 501, kinds[i * 5 % 11 % 3], float(i)) for i in range(20000)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")

    def live(below):
        last = {k: (e, v) for i, k, e, v in events if i < below}
        return {(k, v) for k, (e, v) in last.items() if e != "error"}

    got = catalogue.store_flush_and_compact(spark, str(tmp_path)).collect()
    assert {(r.key, r.value) for r in got} == live(16000) and len(got) == len(live(16000))
    assert {(r.key, r.value) for r in made[0].snapshot().collect()} == live(20000)
    assert all(s.level == 1 for s in made[0].manifest().segments)
