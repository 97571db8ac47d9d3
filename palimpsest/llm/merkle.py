"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text is cut after every line feed and after white space that the eight bytes before it select (about every
second), and a leaf that grows too long is cut there; one rule holds for the whole of it. An edit moves no cut beyond
its own surroundings. The pieces are the leaves, a line's leaves
make a paragraph, and paragraphs up to one whose digest selects it make a section. The root (128 bit) tests
equality. The fingerprint also holds the tree's shape and a 32-bit tag of each leaf, so that two fingerprints
alone tell which branches differ and how alike the texts are.

Null text counts as empty; texts of any length are read whole. Empty tables give no rows. Rows with equal ids, repeated
ones too, are ordered by text; null ids come last in descending order. Ids are whole numbers or texts. Other columns pass
through, and one called like a new one, in whatever case, is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm.shared import append_columns, small_batches

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(63)
_PAD = b"\0" * 8
#: No leaf is longer.
LONGEST = 128


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cuts(data: bytes, start: int) -> list[int]:
    """Ends of the leaves of data from the cut `start` on, as byte offsets; the last is len(data)."""
    back = max(0, start - 8)
    padded = _PAD + data[back:]
    raw = np.frombuffer(padded, np.uint8)[8:]
    at = np.flatnonzero(_SPACE[raw])
    before = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[at]
    ends = at[((before * _MIX) >> _SHIFT == 0) | (raw[at] == 10)] + (back + 1)
    ends = np.append(ends[ends > start], len(data))
    gaps = np.diff(ends, prepend=start)
    if gaps.max(initial=0) <= LONGEST:
        return ends.tolist() if len(ends) < 2 or ends[-1] != ends[-2] else ends[:-1].tolist()
    out, last = [], start
    for e in ends.tolist():
        out.extend(range(last + LONGEST, e, LONGEST))
        if e > last:
            out.append(e)
        last = e
    return out


class Tree(NamedTuple):
    root: str
    #: leaf digests, byte ends of the leaves, and the shape: leaves of each paragraph of each section
    leaves: list[bytes]
    ends: list[int]
    shape: list[list[int]]

    def text(self) -> str:
        tags = base64.b64encode(b"".join([d[:4] for d in self.leaves])).decode()
        return f"{self.root}:{';'.join(','.join(map(str, s)) for s in self.shape)}:{tags}"


def build(data: bytes, known: Tree | None = None, shared: int = 0) -> Tree:
    """The tree of UTF-8 bytes. known is the tree of bytes that agree in the first `shared`; its leaves there are reused."""
    if not data:
        return Tree(_digest(b"").hex(), [], [], [])
    leaves: list[bytes] = []
    ends: list[int] = []
    if known is not None and known.ends:
        k = int(np.searchsorted(known.ends, shared, "right"))
        k -= bool(k) and k == len(known.ends)  # its last leaf may end without a cut
        leaves, ends = known.leaves[:k], known.ends[:k]
    at = ends[-1] if ends else 0
    for e in _cuts(data, at) if at < len(data) else []:
        leaves.append(_digest(data[at:e]))
        ends.append(e)
        at = e
    shape: list[list[int]] = []
    sections: list[bytes] = []
    first, section, inner = 0, [], []
    for i, e in enumerate(ends):
        if data[e - 1] == 10 or i == len(ends) - 1:
            paragraph = _digest(b"".join(leaves[first : i + 1]))
            section.append(i + 1 - first)
            inner.append(paragraph)
            first = i + 1
            if not paragraph[0] & 3 or i == len(ends) - 1:
                sections.append(_digest(b"".join(inner)))
                shape.append(section)
                section, inner = [], []
    return Tree(_digest(b"".join(sections)).hex(), leaves, ends, shape)


def fingerprint(text: str | None) -> str:
    return build((text or "").encode()).text()


def _dice(a: list[bytes], b: list[bytes]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    n, m, head, tail = len(a), len(b), 0, 0
    least = min(n, m)
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    middle = Counter(a[head : n - tail]) & Counter(b[head : m - tail])
    return 2 * (head + tail + sum(middle.values())) / (n + m)


def likeness(a: Tree, b: Tree) -> float:
    """Share of leaves in common (0 to 1), read from the fingerprints' tags; 1 when the roots are equal."""
    return 1.0 if a.root == b.root else min(_dice([x[:4] for x in a.leaves], [x[:4] for x in b.leaves]), 0.999999)


def parse(fingerprint: str) -> Tree:
    """A tree whose leaves are the 32-bit tags, as far as a fingerprint holds it."""
    root, shape, tags = fingerprint.split(":")
    raw = base64.b64decode(tags)
    return Tree(root, [raw[i : i + 4] for i in range(0, len(raw), 4)], [], [[int(n) for n in s.split(",")] for s in shape.split(";")] if shape else [])


def compare(a: str, b: str) -> float:
    return likeness(parse(a), parse(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) branches of a that b lacks, descending only into sections that differ."""
    if a.split(":", 1)[0] == b.split(":", 1)[0]:
        return []

    def branches(t: Tree):
        at = 0
        for s in t.shape:
            paragraphs = []
            for n in s:
                paragraphs.append(b"".join(t.leaves[at : at + n]))
                at += n
            yield tuple(paragraphs)

    theirs = list(branches(parse(b)))
    sections, left = Counter(theirs), Counter(p for s in theirs for p in s)
    found = []
    for i, s in enumerate(branches(parse(a))):
        if sections[s] > 0:
            sections[s] -= 1
            left.subtract(s)
            continue
        for j, p in enumerate(s):
            if left[p] > 0:
                left[p] -= 1
            else:
                found.append((i, j))
    return found


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with a fingerprint per row; a column already called out_col is replaced."""
    return append_columns(df, text_col, lambda texts: [pa.array([fingerprint(t) for t in texts], pa.string())], [(out_col, "string")])


# ---- each document beside the next one ----------------------------------------------------------------


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _numbered(ids: DataFrame) -> Column:
    """A bigint that grows with the id, not strictly: of numbers themselves, of texts the seven bytes after what all have in common."""
    kind = ids.schema["id"].dataType
    if not isinstance(kind, T.StringType):
        return F.col("id").cast("bigint")
    ends = ids.agg(F.min("id"), F.max("id")).first()
    same = os.path.commonprefix([(x or "").encode() for x in ends])
    part = F.hex(F.substring(F.encode("id", "utf-8"), F.lit(len(same) + 1), F.lit(7)))
    return F.conv(F.rpad(part, 14, "0"), 16, 10).cast("bigint")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ids (numbers or texts) and sorted descending, null ids last, each range ended by a copy (`foreign`) of
    the row that follows it, the last range by the very first row. One shuffle of the texts; what reaches the driver is one id a range."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    src = src.withColumn("key", F.coalesce(_numbered(src.select("id")), F.lit(-(2**63))))
    keys = src.select("id", "key")
    marks = keys.approxQuantile("key", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    bounds = sorted({int(x) for x in marks})
    bucket = _bucket(F.col("key"), bounds)
    tops = sorted((r.bucket, r.top) for r in keys.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("top")).collect())
    # the top row of a range follows the range above it; the topmost row follows the lowest range
    above = {b: tops[(i + 1) % len(tops)][0] for i, (b, _) in enumerate(tops)}
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("foreign"))
    places = F.array(own)
    if tops:
        target = F.lit([above.get(b, 0) for b in range(len(bounds) + 1)])
        copy = F.struct(F.get(target, bucket).alias("bucket"), F.lit(True).alias("foreign"))
        leads = F.coalesce(F.col("id").isin([t for _, t in tops if t is not None]), F.lit(False))
        if any(t is None for _, t in tops):  # a range of null ids only, the lowest one
            leads = leads | F.col("id").isNull()
        places = F.when(leads, F.array(own, copy)).otherwise(places)
    placed = src.select("id", "text", F.explode(places).alias("at")).select("at.*", "id", "text")
    dealt = placed.repartitionById(len(bounds) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "foreign", F.desc_nulls_last("id"), "text")


def edited_query(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""

    def row(doc_id, text: str, data: bytes, tree: Tree, following: str, next_tree: Tree) -> tuple:
        k = len(text) // 3
        head = text[: len(text) - k]
        edited = (head + following[:k]).encode()
        edited_tree = build(edited, tree, len(head.encode()))
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), tree.text(), edited_tree.text(), likeness(tree, edited_tree), likeness(tree, next_tree))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            kinds = [b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = []
            for foreign, doc_id, text in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if foreign and held is None:
                    continue
                data = text.encode()
                tree = build(data)
                if held is not None:
                    out.append(row(*held, text, tree))
                held = None if foreign else (doc_id, text, data, tree)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).mapInArrow(run, ddl)
