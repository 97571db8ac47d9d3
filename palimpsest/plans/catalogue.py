"""Registered queries over the driver tables, each beside the DuckDB SQL that checks it.

events is read as an op-log: key user_id, timestamp event_id, a tombstone where event_type is 'error'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.functions import codec
from palimpsest.model import DELETE, oplog
from palimpsest.operators import maintenance, read, replication

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The op-log in SQL, and the newest version of each key below a bound.
_LOG = "(select user_id as key, event_id as commit_ts, case when event_type = 'error' then 'DELETE' else 'PUT' end as op, case when event_type <> 'error' then value end as value from events)"


def _newest(where: str = "true") -> str:
    return f"(select * exclude rn from (select *, row_number() over (partition by key order by commit_ts desc) as rn from {_LOG} where {where}) where rn = 1)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog(_table(spark, sf_dir, "events"), "user_id", "event_id", "value", F.col("event_type") == "error").drop("op_seq")


_LIVE = ("key", "commit_ts", "value")

# ---- snapshot reads ---------------------------------------------------------------------------------


@query(f"select key, commit_ts, value from {_newest('commit_ts <= 5000')} where op <> 'DELETE'")
def mvcc_snapshot(spark, sf_dir):
    return read.snapshot(_log(spark, sf_dir), 5000).select(*_LIVE)


@query(f"select key, commit_ts, value from {_newest()} where op <> 'DELETE'")
def mvcc_latest(spark, sf_dir):
    return read.snapshot(_log(spark, sf_dir)).select(*_LIVE)


@query(f"select key, commit_ts, value from {_newest('commit_ts <= 5000')} where op <> 'DELETE'")
def mvcc_snapshot_ranked(spark, sf_dir):
    """The same read through version ranks, which Catalyst turns into a group limit."""
    ranked = read.history(_log(spark, sf_dir).where("commit_ts <= 5000"))
    return ranked.where((F.col("version_rank") == 1) & (F.col("op") != DELETE)).select(*_LIVE)


@query(f"select key, commit_ts, value from {_newest('commit_ts <= 8000 and key >= 20 and key < 90')} where op <> 'DELETE'")
def mvcc_range_scan(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), 20, 90, 8000).select(*_LIVE)


@query(f"select key, commit_ts, op, value from {_newest('key >= 20 and key < 90')}")
def scan_with_tombstones(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), 20, 90, tombstones=True).select("key", "commit_ts", "op", "value")


@query(f"select key, commit_ts, value from {_newest('key >= 100')} where op <> 'DELETE'")
def scan_from_key(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), start=100).select(*_LIVE)


@query(f"select key, commit_ts, value from {_newest('key < 15')} where op <> 'DELETE'")
def scan_to_key(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), end=15).select(*_LIVE)


@query(f"select key, commit_ts, value from {_newest('key >= 70 and key < 50')}")
def scan_inverted_range(spark, sf_dir):
    return read.scan(_log(spark, sf_dir), 70, 50).select(*_LIVE)


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey >= 3000 order by o_orderkey limit 100")
def scan_limit(spark, sf_dir):
    orders = oplog(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit(1), "o_totalprice")
    return read.scan(orders, start=3000, limit=100).select("key", "value")


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey >= 3000 and o_orderkey < 7000")
def range_scan(spark, sf_dir):
    orders = oplog(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit(1), "o_totalprice")
    return read.scan(orders, 3000, 7000).select("key", "value")


@query("select c_name as key, c_acctbal as value from customer where starts_with(c_name, 'Customer#00000000')")
def prefix_scan(spark, sf_dir):
    customers = oplog(_table(spark, sf_dir, "customer"), "c_name", F.lit(1), "c_acctbal")
    return read.prefix_scan(customers, "Customer#00000000").select("key", "value")


@query("select url as key, page_id as value from pages where url >= 'https://m' order by url, page_id limit 20")
def seek_page(spark, sf_dir):
    pages = oplog(_table(spark, sf_dir, "pages"), "url", F.lit(1), "page_id")
    return read.seek(pages, "https://m", 20).select("key", "value")


@query("select o_orderkey as key, o_totalprice as value from orders where o_orderkey = 1234")
def point_get(spark, sf_dir):
    orders = oplog(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit(1), "o_totalprice")
    return read.get(orders, 1234).select("key", "value")


@query(f"""with wanted as (select distinct c_custkey as key from customer)
select w.key, n.value, n.key is not null as found from wanted w left join (select * from {_newest()} where op <> 'DELETE') n on w.key = n.key""")
def multi_get(spark, sf_dir):
    found = read.multi_get(_log(spark, sf_dir), _table(spark, sf_dir, "customer"), "c_custkey")
    return found.select("key", "value", "found")


@query(f"select distinct o_custkey as key, o_custkey in (select key from {_newest()} where op <> 'DELETE') as found from orders")
def contains_keys(spark, sf_dir):
    return read.contains(_log(spark, sf_dir), _table(spark, sf_dir, "orders"), "o_custkey")


@query(f"select key, commit_ts from {_newest('commit_ts <= 8000')} where op = 'DELETE'")
def deleted_keys(spark, sf_dir):
    return read.deleted_keys(_log(spark, sf_dir), 8000).select("key", "commit_ts")


@query(f"select key, commit_ts, op, row_number() over (partition by key order by commit_ts desc) as version_rank from {_LOG}")
def version_history(spark, sf_dir):
    return read.history(_log(spark, sf_dir)).select("key", "commit_ts", "op", "version_rank")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (select *, row_number() over (
  partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as rn from lineitem) where rn = 1""")
def composite_key_latest(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    newest = F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("v")
    return items.groupBy("l_orderkey", "l_linenumber").agg(newest).select("l_orderkey", "l_linenumber", "v.l_partkey", "v.l_suppkey", "v.l_quantity")


@query("""with p as (select o_orderkey, o_custkey % 150 as key, o_orderkey % 10000 as at from orders),
 v as (select user_id as key, event_id as commit_ts, case when event_type = 'error' then 'DELETE' else 'PUT' end as op from events)
select p.o_orderkey, p.key, p.at, v.commit_ts, v.op from p asof left join v on p.key = v.key and p.at >= v.commit_ts""")
def asof_multi_get(spark, sf_dir):
    probes = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("key"), (F.col("o_orderkey") % 10000).alias("at"))
    return read.asof(probes, _log(spark, sf_dir)).select("o_orderkey", "key", "at", "commit_ts", "op")


@query(ORACLE_SQL["asof_multi_get"])
def asof_multi_get_stretched(spark, sf_dir):
    """The same with each key's time line cut into parallel stretches."""
    probes = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("key"), (F.col("o_orderkey") % 10000).alias("at"))
    return read.asof(probes, _log(spark, sf_dir), span=1000).select("o_orderkey", "key", "at", "commit_ts", "op")


# ---- merges and transactions ------------------------------------------------------------------------


@query(f"select key, commit_ts, value from {_newest()} where op <> 'DELETE'")
def merge_newest_wins(spark, sf_dir):
    """The log as three sources of equal time spans, newest first."""
    log = _log(spark, sf_dir)
    span = F.broadcast(log.agg((F.max("commit_ts") + 1).alias("span")))  # one row
    third = log.crossJoin(span).withColumn("third", F.floor(F.col("commit_ts") * 3 / F.col("span"))).drop("span")
    return read.merge_newest_wins([third.where(F.col("third") == i).drop("third") for i in (2, 1, 0)]).select(*_LIVE)


@query(f"""with buffer as (select * from {_newest('commit_ts between 9990 and 9999')}), base as (select * from {_newest('commit_ts <= 5000')} where op <> 'DELETE')
select key, commit_ts, value from base where key not in (select key from buffer) union all select key, commit_ts, value from buffer where op <> 'DELETE'""")
def read_your_writes(spark, sf_dir):
    log = _log(spark, sf_dir)
    return read.overlay(read.snapshot(log, 5000), log.where("commit_ts between 9990 and 9999")).select(*_LIVE)


@query("""select t.event_id as txn, t.user_id as key, count(*) as competing from events t join events v
  on v.user_id = t.user_id and v.event_id > t.event_id - 100 and v.event_id < t.event_id where t.event_type = 'purchase' group by t.event_id, t.user_id""")
def txn_conflicts(spark, sf_dir):
    """Versions committed between a transaction's start (its commit - 100) and its commit, counted from running totals."""
    events = _table(spark, sf_dir, "events")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-99, -1)
    counted = events.select(F.col("event_id").alias("txn"), F.col("user_id").alias("key"), "event_type", F.count("*").over(w).alias("competing"))
    return counted.where("event_type = 'purchase' and competing > 0").select("txn", "key", "competing")


@query("select distinct user_id as key from events where event_type = 'purchase' and event_id <= 5000 and user_id in (select user_id from events where event_id > 5000)")
def txn_conflict_keys(spark, sf_dir):
    log = _log(spark, sf_dir)
    writes = _table(spark, sf_dir, "events").where("event_type = 'purchase' and event_id <= 5000").select(F.col("user_id").alias("key")).distinct().withColumn("start_ts", F.lit(5000))
    return read.conflicts(writes, log).select("key")


@query("select distinct user_id as key from events union select distinct o_custkey from orders")
def write_set_union(spark, sf_dir):
    a = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    return a.union(_table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("select o_custkey as key from orders except select user_id from events")
def keyset_diff(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).subtract(_log(spark, sf_dir).select("key"))


@query("""select o_orderkey as key from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey)
  and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def semi_anti_keys(spark, sf_dir):
    flags = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return orders.join(flags.where("not returned"), "key", "left_semi")


# ---- statistics and layout --------------------------------------------------------------------------


@query(f"""select count(distinct key) as entry_count, sum(length(key::varchar) + 8)::bigint as approximate_size,
  (count(*) filter (where op = 'DELETE'))::bigint as tombstones, max(commit_ts) as last_commit_ts from {_LOG}""")
def memtable_stats(spark, sf_dir):
    return read.stats(_log(spark, sf_dir), size=F.length(F.col("key").cast("string")) + 8)


@query("""with s as (select o_orderkey as k, 20 + length(o_orderpriority) as n from orders),
 b as (select k, n, ((sum(n) over (order by k) - n) // 4096)::bigint as block from s)
select block, min(k) as min_key, max(k) as max_key, count(*) as n_rows, sum(n)::bigint as n_bytes from b group by block""")
def block_index(spark, sf_dir):
    return maintenance.block_index(_table(spark, sf_dir, "orders"), "o_orderkey", F.lit(20) + F.length("o_orderpriority"))


@query("""with k as (select c_name, c_nationkey, row_number() over (partition by c_nationkey order by c_name) - 1 as i, lag(c_name) over (partition by c_nationkey order by c_name) as p from customer)
select c_name as key, case when i % 16 = 0 then 0 else coalesce(list_sum(list_transform(range(1, least(length(p), length(c_name)) + 1), lambda j: (substr(p, 1, j) = substr(c_name, 1, j))::int)), 0) end::int as shared_len from k""")
def prefix_compression(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), "c_nationkey")
    return maintenance.prefix_compressed(keys, "key", within="c_nationkey").select("key", "shared_len")


def _files(spark, sf_dir):
    return _log(spark, sf_dir).groupBy((F.col("commit_ts") % 12).alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query(f"""with f as (select commit_ts % 12 as file, min(key) as min_key, max(key) as max_key from {_LOG} group by 1
    union all select 100 + key // 13, min(key), max(key) from {_LOG} group by 1),
 i as (select n_nationkey as probe, n_nationkey * 6 as s, n_nationkey * 6 + 3 as e from nation)
select f.file, i.probe from f join i on f.max_key >= i.s and f.min_key < i.e""")
def file_overlap(spark, sf_dir):
    """Intervals against twelve files by time, which cover nearly all keys, and files by key."""
    by_key = _log(spark, sf_dir).groupBy((F.lit(100) + F.floor(F.col("key") / 13)).alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    probes = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("probe"), (F.col("n_nationkey") * 6).alias("start"), (F.col("n_nationkey") * 6 + 3).alias("end"))
    return maintenance.overlapping(_files(spark, sf_dir).unionByName(by_key), F.broadcast(probes)).select("file", "probe")


@query(f"select commit_ts % 12 as file, min(key) as min_key, max(key) as max_key, count(*) as n_rows from {_LOG} group by 1")
def file_catalog(spark, sf_dir):
    return _log(spark, sf_dir).groupBy((F.col("commit_ts") % 12).alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"))


@query(f"select f.file from (select distinct commit_ts % 12 as file from {_LOG}) f where f.file not in (1, 2, 3) union all select 100")
def manifest_after_compaction(spark, sf_dir):
    files = _files(spark, sf_dir)
    inputs = files.where("file in (1, 2, 3)")
    outputs = inputs.agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key")).select(F.lit(100).cast("bigint").alias("file"), "min_key", "max_key")
    return maintenance.manifest_after(files, inputs, outputs).select("file")


@query(f"select key, commit_ts, op, value from {_LOG} where commit_ts > 8000 union all select key, commit_ts, op, value from {_newest('commit_ts <= 8000')} where op <> 'DELETE'")
def version_gc(spark, sf_dir):
    return maintenance.collect_versions(_log(spark, sf_dir), 8000)


@query(f"select key, commit_ts, value from {_newest()} where op <> 'DELETE'")
def compaction_invariance(spark, sf_dir):
    """The latest snapshot over a compacted log equals that over the log."""
    log = _log(spark, sf_dir)
    return read.snapshot(maintenance.compact(log.union(log.where("commit_ts % 3 = 0")), 4)).select(*_LIVE)


@query("select (event_id % 16)::bigint as bucket, count(*) as n_rows, min(event_id) as min_ts, max(event_id) as max_ts from events group by 1")
def bucket_stats(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.groupBy((F.col("event_id") % 16).alias("bucket")).agg(F.count("*").alias("n_rows"), F.min("event_id").alias("min_ts"), F.max("event_id").alias("max_ts"))


# ---- functions --------------------------------------------------------------------------------------


@query("select event_id as commit_ts, lower(hex(encode('user:' || user_id::varchar))) || lower(printf('%016x', -event_id - 1)) as encoded from events")
def mvcc_key_encode(spark, sf_dir):
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_ts"), codec.to_hex(codec.encode_version(key, F.col("event_id"))).alias("encoded"))


@query("select event_id as commit_ts, 'user:' || user_id::varchar as key from events")
def mvcc_key_decode(spark, sf_dir):
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    encoded = codec.encode_version(key, F.col("event_id"))
    return _table(spark, sf_dir, "events").select(codec.decode_ts(encoded).alias("commit_ts"), codec.to_text(codec.decode_key(encoded)).alias("key"))


@query("""select c_name as key, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::bigint)),
  lambda h, b: (xor(h, b) * 16777619) & 4294967295)::bigint as fnv from customer""")
def fnv_hash(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), codec.fnv1a(F.col("c_name").cast("binary")).alias("fnv"))


@query("""with h as (select c_name, list_reduce(list_prepend(0::bigint, list_transform(string_split(c_name, ''), lambda x: ascii(x)::bigint)),
  lambda h, b: (h * 31 + b) & 4294967295) as u from customer)
select c_name as key, abs(case when u >= 2147483648 then u - 4294967296 else u end % 16)::int as bucket from h""")
def hash_bucket(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), codec.polynomial_bucket(F.col("c_name").cast("binary"), 16).alias("bucket"))


#: CRC-32 in SQL: its table by rule, then a byte at a time.
_CRC = """(select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


@query(f"""with l as (select key, commit_ts, key::varchar as k, coalesce(floor(value)::bigint::varchar, '') as v, op from {_LOG}),
 b as (select key, commit_ts, list_concat([case when op = 'PUT' then 0 else 1 end, 0, 0, 0, length(k)], list_transform(string_split(k, ''), lambda x: ascii(x)),
   [0, 0, 0, length(v)], list_transform(list_filter(string_split(v, ''), lambda x: x <> ''), lambda x: ascii(x)))::bigint[] as bytes from l)
select key, commit_ts, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295)::bigint as crc from b, {_CRC}""")
def record_checksum(spark, sf_dir):
    """CRC-32 of every operation as a log record, values as whole numbers in decimal."""
    log = _log(spark, sf_dir)
    value = F.floor("value").cast("bigint").cast("string").cast("binary")
    return log.select("key", "commit_ts", codec.record_crc(F.col("op"), F.col("key").cast("string").cast("binary"), value).alias("crc"))


@query("""with r as (select event_id % 8 as file, event_id as seq, event_id % 1999 = 1500 as bad from events)
select r.file, r.seq from r left join (select file, min(seq) as stop from r where bad group by file) s on r.file = s.file where s.stop is null or r.seq < s.stop""")
def wal_recovery(spark, sf_dir):
    """Log records as eight files, some checksums damaged; each file replays up to its first damaged record."""
    log = _log(spark, sf_dir).select("commit_ts", "op", F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"))
    crc = codec.record_crc(F.col("op"), F.col("key"), F.col("value"))
    damaged = F.when(F.col("commit_ts") % 1999 == 1500, crc + 1).otherwise(crc)
    records = log.select((F.col("commit_ts") % 8).alias("file"), F.col("commit_ts").alias("seq"), "op", "key", "value", damaged.alias("crc"))
    return maintenance.recover(records).select("file", "seq")


@query(f"select key::varchar as key, op, floor(value)::bigint as value, commit_ts from {_LOG}")
def command_round_trip(spark, sf_dir):
    log = _log(spark, sf_dir)
    value = F.floor("value").cast("bigint").cast("string").cast("binary")
    sent = codec.encode_command(F.col("op"), F.col("key").cast("string").cast("binary"), value)
    back = log.select("commit_ts", codec.decode_command(sent).alias("c"))
    return back.select(codec.to_text(F.col("c.key")).alias("key"), "c.op", codec.to_text(F.col("c.value")).cast("bigint").alias("value"), "commit_ts")


@query(f"select key, (row_number() over (partition by key order by commit_ts))::int as place, op, floor(value)::bigint as value from {_LOG}")
def command_batch(spark, sf_dir):
    """The operations of every key, in order, through one batch command a key."""
    value = F.floor("value").cast("bigint").cast("string").cast("binary")
    one = F.struct("commit_ts", "op", F.col("key").cast("string").cast("binary").alias("key"), value.alias("value"))
    batches = _log(spark, sf_dir).groupBy("key").agg(codec.encode_batch(F.sort_array(F.collect_list(one))).alias("sent"))
    back = batches.select("key", F.posexplode(codec.decode_batch(F.col("sent"))).alias("place", "c"))
    return back.select("key", (F.col("place") + 1).alias("place"), "c.op", codec.to_text(F.col("c.value")).cast("bigint").alias("value"))


@query("select c_custkey as key, hex(encode(c_name)) || '8000000000000000' as first, hex(encode(c_name)) || 'FF' as stop from customer")
def scan_bounds(spark, sf_dir):
    """The encoded interval that holds every version of a key."""
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.hex(codec.scan_start(name)).alias("first"), F.hex(codec.scan_end(name)).alias("stop"))


@query("""select n_nationkey as id, 'host' || n_regionkey::varchar || ':' || (7000 + n_nationkey)::varchar as address, case when n_nationkey % 2 = 0 then n_nationkey else (7000 + n_nationkey) % 100 end::int as node_id from nation""")
def peer_parse(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    host = F.concat(F.lit("host"), F.col("n_regionkey").cast("string"))
    port = F.col("n_nationkey") + 7000
    spec = F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), host, F.lit(":"), port.cast("string"), F.lit(",bad"))
    peers = codec.parse_peers(spec)
    address = F.concat(host, F.lit(":"), port.cast("string"))
    mine = F.when(F.col("n_nationkey") % 2 == 0, codec.node_id(peers, address, port)).otherwise(codec.node_id(peers, F.lit("nowhere"), port))
    return nation.select(peers[0]["id"].alias("id"), peers[0]["address"].alias("address"), mine.alias("node_id"))


@query("select conv_id, turn, lower(regexp_extract(trim(text), '^(\\S+)', 1)) as verb, length(regexp_extract(trim(text), '^\\S+\\s+(\\S+)', 1))::int as first_chars from conversations where trim(text) <> ''")
def command_tokens(spark, sf_dir):
    """The interactive tokenizer over every conversation turn."""
    rows = _table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    c = codec.tokenise_command(F.col("text"))
    return rows.select("conv_id", "turn", c["verb"].alias("verb"), F.coalesce(F.length(c["first"]), F.lit(0)).alias("first_chars"))


# ---- replication and cluster ------------------------------------------------------------------------
# five peers, event_id % 5; each event acknowledges an index, the later peers ever further behind

_ACKS = "(select event_id % 5 as peer_id, max(event_id - event_id % 5 * 97) as match_index from events group by 1)"


def _acks(spark, sf_dir):
    peer = F.col("event_id") % 5
    return _table(spark, sf_dir, "events").select(peer.alias("peer_id"), (F.col("event_id") - peer * 97).alias("match_index"))


@query(f"select e.event_id as log_index, count(*) filter (where a.match_index >= e.event_id) as n_acks, count(*) filter (where a.match_index >= e.event_id) >= 3 as committed from events e, {_ACKS} a group by e.event_id")
def quorum_acks(spark, sf_dir):
    indexes = _table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"))
    return replication.acknowledged(indexes, _acks(spark, sf_dir), 3)


@query(f"select count(*) filter (where match_index >= 900) as n_acks, count(*) filter (where match_index >= 900) >= 3 as ok from {_ACKS}")
def wait_replicas(spark, sf_dir):
    return replication.wait_for(_acks(spark, sf_dir), 900, 3)


@query(f"select (list_sort(list(match_index), 'DESC'))[3] as majority_index, min(match_index) as all_index from {_ACKS}")
def commit_index(spark, sf_dir):
    return replication.commit_index(_acks(spark, sf_dir))


@query(f"""with m as (select (list_sort(list(match_index), 'DESC'))[3] as majority_index, min(match_index) as all_index from {_ACKS})
select majority_index, all_index, majority_index // 1000 = t.term as commits from m, (select max(event_id) // 1000 as term from events union all select 3) t""")
def commit_index_of_term(spark, sf_dir):
    """A majority's index commits only under a leader of the term of its entry: once asked in the log's last term, once in an old one."""
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"), F.floor(F.col("event_id") / 1000).alias("term"))
    now = log.agg(F.max("term").alias("current"))
    old = spark.createDataFrame([(3,)], "current bigint")
    return replication.commit_index(_acks(spark, sf_dir), now.union(old), log)


@query("""select user_id as term, event_id % 3 as candidate, count(distinct case when event_type in ('click', 'view') then event_id % 13 end) as n_votes,
  count(distinct case when event_type in ('click', 'view') then event_id % 13 end) > 6 as elected from events group by 1, 2""")
def vote_tally(spark, sf_dir):
    votes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("term"), (F.col("event_id") % 3).alias("candidate"), (F.col("event_id") % 13).alias("voter"), F.col("event_type").isin("click", "view").alias("granted"))
    return replication.vote_tally(votes, 13)


@query("""select cluster, candidate, last_index from (select user_id % 20 as cluster, user_id as candidate, max(event_id // 50) as last_index,
  row_number() over (partition by user_id % 20 order by max(event_id // 50) desc, user_id) as rn from events group by 1, 2) where rn = 1""")
def elected_candidate(spark, sf_dir):
    """Of a cluster's candidates the one whose log is furthest; of equals the lowest id."""
    events = _table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("cluster"), F.col("user_id").alias("candidate"), F.floor(F.col("event_id") / 50).alias("last_index"))
    return replication.elect(events, "cluster", "candidate", "last_index").select("cluster", "candidate", "last_index")


@query("""with e as (select max(event_id // 1000) as t, max(event_id) as i from events)
select c_custkey as candidate, (c_custkey % 15 > t or (c_custkey % 15 = t and c_custkey * 9 >= i)) as log_ok from customer, e""")
def vote_rule(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("term"), F.col("event_id").alias("log_index"))
    asks = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate"), (F.col("c_custkey") % 15).alias("last_term"), (F.col("c_custkey") * 9).alias("last_index"))
    return replication.may_grant(asks, log).select("candidate", "log_ok")


def _two_logs(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"), F.floor(F.col("event_id") / 100).alias("term"))
    return log, log.withColumn("term", F.when(F.col("log_index") > 777, F.col("term") + 1).otherwise(F.col("term")))


@query("select min(event_id) as first_conflict from events where event_id > 777")
def log_divergence(spark, sf_dir):
    return replication.first_divergence(*_two_logs(spark, sf_dir))


@query("select event_id as log_index, event_id // 100 as term from events where event_id < (select min(event_id) from events where event_id > 777)")
def log_truncation(spark, sf_dir):
    return replication.truncate_conflicts(*_two_logs(spark, sf_dir))


@query("select event_id as log_index, user_id from events where event_id between 500 and 563")
def append_batch(spark, sf_dir):
    return replication.next_entries(_table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"), "user_id"), 500)


@query("""with n as (select count(*) as n, max(event_id) as last from events)
select row_number() over (order by o_orderdate, o_orderkey) + last as log_index, 7 as term, o_orderkey as key from orders, n""")
def propose_entries(spark, sf_dir):
    """All orders, by date, appended to the log of events: indexes go on from its last one."""
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"))
    entries = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate")
    return replication.propose(log, entries, 7, ["o_orderdate", "key"]).select("log_index", "term", "key")


@query(f"""select a.peer_id, e.event_id as log_index, (e.event_id - a.match_index - 1) // 64 as batch from {_ACKS} a join events e on e.event_id > a.match_index""")
def catch_up_batches(spark, sf_dir):
    """What each peer lacks, in batches of 64 entries from its next index on."""
    log = _table(spark, sf_dir, "events").select(F.col("event_id").alias("log_index"))
    return replication.batches_to_peers(log, _acks(spark, sf_dir), 64)


@query(f"select peer_id, match_index, (select max(match_index) from {_ACKS}) - match_index as lag from {_ACKS}")
def replica_lag(spark, sf_dir):
    return replication.replica_lag(_acks(spark, sf_dir))


@query("""with g as (select user_id, event_id, ts, epoch_us(lead(ts) over w) - epoch_us(ts) as gap_micros, epoch_us(ts) - epoch_us(lag(ts) over w) as back from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id, gap_micros, coalesce(gap_micros > 86400000000, false) as expired,
  sum(case when back > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id)::bigint as session from g""")
def lease_expiry(spark, sf_dir):
    beats = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return replication.lease_gaps(beats, "user_id", "ts", 86400, "event_id").select("user_id", "event_id", "gap_micros", "expired", "session")


@query("""with g as (select user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) over w) as back from events window w as (partition by user_id order by ts, event_id)),
 s as (select user_id, ts, sum(case when back is null or back > 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from g)
select user_id, epoch_us(min(ts))::bigint as held_from, (epoch_us(max(ts)) + 86400000000)::bigint as expires_at, count(*) as n_beats from s group by user_id, session""")
def lease_sessions(spark, sf_dir):
    from palimpsest.streaming.apply import lease_sessions as sessions

    found = sessions(_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "24 hours")
    return found.select("user_id", F.unix_micros("held_from").alias("held_from"), F.unix_micros("expires_at").alias("expires_at"), "n_beats")


@query("""with l as (select user_id, max(ts) as last from events group by user_id), n as (select max(ts) as now from events)
select user_id from l, n where epoch_us(now) - epoch_us(last) > 3600000000 * 24""")
def stale_nodes(spark, sf_dir):
    return replication.stale_nodes(_table(spark, sf_dir, "events"), "user_id", "ts", None, 86400).select("user_id")


@query("""select user_id % 10 as cluster, arg_max(case when event_type = 'signup' then user_id end, case when event_type = 'signup' then event_id end) as leader,
  count(distinct user_id) as n_nodes, max(event_id) as last_heartbeat from events group by 1""")
def cluster_leader(spark, sf_dir):
    beats = _table(spark, sf_dir, "events").withColumn("cluster", F.col("user_id") % 10)
    return replication.cluster_leader(beats, "cluster", "user_id", "event_id", F.col("event_type") == "signup")


@query("""with a as (select user_id % 10 as cluster, user_id, arg_max(event_type, event_id) as address from events group by 1, 2),
 l as (select user_id % 10 as cluster, arg_max(case when event_type = 'signup' then user_id end, case when event_type = 'signup' then event_id end) as leader from events group by 1)
select a.cluster, l.leader, a.user_id as peer, a.address from a join l on a.cluster = l.cluster""")
def cluster_info(spark, sf_dir):
    beats = _table(spark, sf_dir, "events").withColumn("cluster", F.col("user_id") % 10)
    return replication.cluster_info(beats, "cluster", "user_id", "event_type", "event_id", F.col("event_type") == "signup")


# ---- store and streams ------------------------------------------------------------------------------


def _store(spark, key_type, value_type, **kw):
    from palimpsest.sources.store import Store
    from palimpsest.sources.workspace import workspace

    return Store.create(spark, workspace(spark, "store"), key_type, value_type, **kw)


@query(f"select key, value from {_newest('commit_ts <= (select max(event_id) * 4 // 5 from events)')} where op <> 'DELETE'")
def store_flush_and_compact(spark, sf_dir):
    """The whole log committed to a store in five batches, compacted on the way and at the end, read back as of the fourth."""
    log = _log(spark, sf_dir).withColumn("op_seq", F.col("commit_ts").cast("int"))
    store = _store(spark, "bigint", "double")
    last = log.agg(F.max("commit_ts")).first()[0] or 0
    ends = [-1, *(last * i // 5 for i in range(1, 6))]
    commits = [store.write(log.where((F.col("commit_ts") > lo) & (F.col("commit_ts") <= hi))) for lo, hi in zip(ends, ends[1:])]
    store.compact()
    return store.snapshot(commits[3]).select("key", "value")


@query("""select key, value from (select c_custkey as key, case when c_custkey % 10 = 3 then c_acctbal + 1 else c_acctbal end as value from customer)
where key % 10 <> 7""")
def store_levels(spark, sf_dir):
    """Customers in small level-1 files; a batch over some of them is merged with the files that it overlaps, the others stay."""
    store = _store(spark, "bigint", "double", l0_trigger=100, target_bytes=8192)
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("PUT").alias("op"), F.col("c_acctbal").alias("value"))
    store.write(rows)
    store.compact()
    store.write(rows.where("key % 10 = 3").withColumn("value", F.col("value") + 1))
    store.write(rows.where("key % 10 = 7").select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("double").alias("value")))
    store.compact()
    store.vacuum()
    return store.snapshot().select("key", "value")


@query("select 1 as level, count(*) as n_rows, min(o_orderkey)::varchar as min_key, max(o_orderkey)::varchar as max_key, true as disjoint from orders")
def store_catalog(spark, sf_dir):
    """What the manifest says of orders in many level-1 files."""
    from pyspark.sql import Window

    store = _store(spark, "bigint", "double", target_bytes=65536)
    store.write(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("PUT").alias("op"), F.col("o_totalprice").alias("value")))
    store.compact()
    before = F.lag(F.col("max_key").cast("bigint")).over(Window.partitionBy("level").orderBy(F.col("min_key").cast("bigint")))  # a row a file
    files = store.catalog().withColumn("apart", F.coalesce(before < F.col("min_key").cast("bigint"), F.lit(True)))
    number = lambda f, c: f(F.col(c).cast("bigint")).cast("string").alias(c)
    return files.groupBy("level").agg(F.sum("n_rows").alias("n_rows"), number(F.min, "min_key"), number(F.max, "max_key"), F.bool_and("apart").alias("disjoint"))


@query("""select c_custkey as key, case when c_nationkey < 10 then c_acctbal * 2 else c_acctbal end as value from customer where c_nationkey < 20""")
def store_transactions(spark, sf_dir):
    """Three transactions over all customers from one snapshot: one doubles some, one deletes others, and one that overlaps the first is refused."""
    from palimpsest.sources.store import ConflictError

    store = _store(spark, "bigint", "double")
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("PUT").alias("op"), F.col("c_acctbal").alias("value"), "c_nationkey")
    store.write(customers)
    one, two, three = store.begin(), store.begin(), store.begin()
    one.write(customers.where("c_nationkey < 10").withColumn("value", F.col("value") * 2))
    two.write(customers.where("c_nationkey >= 20").withColumn("op", F.lit(DELETE)))
    three.write(customers.where("c_nationkey between 5 and 15").withColumn("value", F.lit(0.0)))
    one.commit()
    two.commit()
    try:
        three.commit()
    except ConflictError:
        return store.snapshot().select("key", "value")
    raise AssertionError("a transaction overwrote another one's keys")


@query(f"select key, value from {_newest()} where op <> 'DELETE'")
def stream_apply(spark, sf_dir):
    """The replicated log applied by a stream in index order, once, and the store read afterwards."""
    from palimpsest.sources.workspace import workspace
    from palimpsest.streaming.apply import apply_log

    store = _store(spark, "bigint", "double")
    schema = _table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern also takes a single file
    deleted = F.col("event_type") == "error"
    entries = events.select(F.col("event_id").alias("log_index"), F.col("user_id").alias("key"), F.when(deleted, DELETE).otherwise("PUT").alias("op"), F.when(~deleted, F.col("value")).alias("value"))
    apply_log(entries, store, workspace(spark, "checkpoint")).awaitTermination()
    return store.snapshot().select("key", "value")
