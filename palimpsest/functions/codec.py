"""Codecs and hashes as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encode_version(key: Column, ts: Column) -> Column:
    """key followed by the big-endian complement of ts: newer versions of a key sort first."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(F.bitwise_not(ts.cast("bigint"))), 16, "0")))


def decode_key(encoded: Column) -> Column:
    """The key of an encoded version; null when shorter than a timestamp."""
    return F.when(F.length(encoded) >= 8, F.substring(encoded, F.lit(1), F.length(encoded) - 8))


def decode_ts(encoded: Column) -> Column:
    tail = F.substring(encoded, F.length(encoded) - 7, F.lit(8))
    return F.when(F.length(encoded) >= 8, F.bitwise_not(F.conv(F.hex(tail), 16, -10).cast("bigint")))


def scan_start(key: Column) -> Column:
    """The least encoded version of key, that is its newest possible one."""
    return encode_version(key, F.lit(2**63 - 1))


def scan_end(key: Column) -> Column:
    return F.concat(key.cast("binary"), F.unhex(F.lit("FF")))


def byte_values(data: Column) -> Column:
    """The unsigned bytes of a binary column as an array of bigint; empty for empty data."""
    text = F.hex(data)
    places = F.sequence(F.lit(1), F.length(text) - 1, F.lit(2))
    return F.when(F.length(text) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.conv(F.substring(text, i, F.lit(2)), 16, 10).cast("bigint")))


def fnv1a(data: Column) -> Column:
    """32-bit FNV-1a as an unsigned bigint."""
    return F.aggregate(byte_values(data), F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def polynomial_bucket(data: Column, buckets: int) -> Column:
    """Bucket of the 31-polynomial hash over signed bytes in 32-bit arithmetic, its magnitude modulo buckets."""
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b)
    wrapped = F.aggregate(byte_values(data), F.lit(0).cast("bigint"), lambda h, b: (h * 31 + signed(b)).bitwiseAND(F.lit(0xFFFFFFFF)))
    whole = F.when(wrapped >= 2**31, wrapped - 2**32).otherwise(wrapped)
    return F.abs(F.when(whole < 0, -(F.abs(whole) % buckets)).otherwise(whole % buckets)).cast("int")


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes in common; 0 when either is null."""
    pairs = F.arrays_zip(byte_values(a).alias("x"), byte_values(b).alias("y"))
    same = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, p: F.struct((s["n"] + F.when(s["on"] & (p["x"] == p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")),
    )
    return F.coalesce(same["n"], F.lit(0))


def record_crc(op: Column, key: Column, value: Column) -> Column:
    """Checksum of one log record: type byte, key and value with their lengths."""

    def sized(x: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.length(x)), 8, "0")), x)

    kind = F.when(op == "PUT", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    return F.crc32(F.concat(kind, sized(key), sized(F.coalesce(value, F.unhex(F.lit(""))))))


def encode_command(op: Column, key: Column, value: Column) -> Column:
    """One operation as bytes: type, key length, key, value length (-1 for none), value."""
    size = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    kind = F.when(op == "PUT", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    tail = F.when(value.isNull(), F.unhex(F.lit("FFFFFFFF"))).otherwise(F.concat(size(F.length(value)), value))
    return F.concat(kind, size(F.length(key)), key, tail)


def decode_command(data: Column) -> Column:
    """struct(op, key, value) of encode_command's bytes."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("bigint").cast("int")
    klen = number(F.lit(2))
    vlen = F.conv(F.hex(F.substring(data, klen + 6, F.lit(4))), 16, 10).cast("bigint")
    return F.struct(
        F.when(F.substring(data, 1, 1) == F.unhex(F.lit("00")), "PUT").otherwise("DELETE").alias("op"),
        F.substring(data, F.lit(6), klen).alias("key"),
        F.when(vlen < 2**31, F.substring(data, klen + 10, vlen.cast("int"))).alias("value"),
    )


def _int32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def encode_batch(ops: Column) -> Column:
    """An array of struct(op, key, value) as bytes: type 2, their number, then of each its type, key and value with their lengths. A
    missing value has length 0."""
    one = lambda x: F.concat(F.when(x["op"] == "PUT", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), _int32(F.length(x["key"])), x["key"], _int32(F.coalesce(F.length(x["value"]), F.lit(0))), F.coalesce(x["value"], F.unhex(F.lit(""))))
    # joined as text, for bytes have no array join
    return F.concat(F.unhex(F.lit("02")), _int32(F.size(ops)), F.unhex(F.array_join(F.transform(ops, lambda x: F.hex(one(x))), "")))


def decode_batch(data: Column) -> Column:
    """The array of struct(op, key, value) of encode_batch's bytes; empty values of a DELETE are null."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(4))), 16, 10).cast("int")
    kind = "array<struct<op:string,key:binary,value:binary>>"

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        klen = number(at + 1)
        vlen = number(at + 5 + klen)
        put = F.substring(data, at, F.lit(1)) == F.unhex(F.lit("00"))
        value = F.when(put, F.substring(data, at + 9 + klen, vlen))
        one = F.struct(F.when(put, "PUT").otherwise("DELETE").alias("op"), F.substring(data, at + 5, klen).alias("key"), value.alias("value"))
        return F.struct((at + 9 + klen + vlen).alias("at"), F.concat(state["ops"], F.array(one)).alias("ops"))

    n = number(F.lit(2))
    start = F.struct(F.lit(6).alias("at"), F.array().cast(kind).alias("ops"))
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, step)["ops"]


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def to_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def to_text(data: Column) -> Column:
    return F.decode(data, "UTF-8")


def parse_peers(spec: Column) -> Column:
    """'1:host:7001,2:host:7002' as an array of struct(id, address); malformed parts are left out."""
    parts = F.filter(F.split(spec, ","), lambda p: p.rlike(r"^\s*[0-9]+:[^:]+:[0-9]+\s*$"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*([0-9]+):", 1).cast("int").alias("id"), F.trim(F.regexp_extract(p, r"^\s*[0-9]+:(.*)$", 1)).alias("address")))


def node_id(peers: Column, address: Column, port: Column) -> Column:
    """The id of the peer with this address, else the port modulo 100."""
    mine = F.filter(peers, lambda p: p["address"] == address)
    return F.coalesce(F.get(mine, F.lit(0))["id"], (port % 100).cast("int"))


def tokenise_command(line: Column) -> Column:
    """Verb (lower case) and at most two arguments of an interactive command."""
    parts = F.split(F.trim(line), r"\s+", 3)
    return F.struct(F.lower(F.get(parts, F.lit(0))).alias("verb"), F.get(parts, F.lit(1)).alias("first"), F.get(parts, F.lit(2)).alias("second"))
