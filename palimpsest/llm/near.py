"""Near-duplicates by bottom-k sketches from one hash function.

Each document's distinct word shingles are hashed once; the K least hashes are its sketch. Documents with
the same set are one class. The least INDEX values of each class are counted over all classes, and inverted
lists keep, per class, its rarest ones: as many as make sure that two sets of at least the asked
similarity meet in a list (for sets no larger than the sketch for certain, else with a chance of missing
below 1e-9 a pair). Passages that many documents share are common values, so they hardly enter the lists.

Lists never turn into all their pairs. Members of short lists are held against each other, those of a long
list against two hubs of it; the links found are contracted to components. Long lists that still hold
several components are settled in full, list by list: members are dealt into bounded blocks, and a task a pair of
blocks compares full sets by matrix products, so no row a pair is ever made. Other pairs pass an estimate from the
union of both sketches and are confirmed by exact Jaccard on full sets.

Sets are sets of 64-bit hashes of shingles, so "exact" means up to two shingles of a pair sharing a hash.

Empty texts (null, or without words) have no shingles and link with nothing. A text with fewer words than
a shingle is one shingle. Rows without an id get a null component and stay. Rows sharing an id are one node.
Of repeated rows all carry the same component; `kept` marks the rows whose id names it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.llm.shared import counted, discard, materialise, small_batches

K, INDEX, MISS = 64, 32, 1e-9
#: Values standing in up to so many classes are compared as pairs; longer lists by hubs, then block by block, a block holding about so much.
SHORT, BLOCK_DOCS, BLOCK_SHINGLES = 16, 512, 1_000_000
#: A task contracting links holds so many nodes at a time.
NODES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for i, base in enumerate((_R, _RINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: polynomial prefix sums over the bytes, mixed with the length."""
    raw = np.frombuffer(text.encode().translate(_LOWER), np.uint8)
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return _mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes (signed 64 bit)."""
    if not text:
        return np.empty(0, np.int64)
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, np.int64)
    width = min(words, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        total = total * np.uint64(_R) + h[j : len(h) - width + 1 + j]
    return np.unique(_mixed(total + np.uint64(width)).view(np.int64))


def least_overlap(k: int, threshold: float) -> int:
    """Largest m such that k draws, each common with chance `threshold`, fall short of m with a chance below MISS."""
    tail, m = 0.0, 0
    while m < k:
        tail += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
        if tail > MISS:
            break
        m += 1
    return max(1, m)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n (set size), digest (null when empty) and sketch per row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, sketches = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(s[:K])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n", "digest", "sketch"])

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return materialise(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n bigint, digest binary, sketch array<bigint>"), "near-signatures")


def inverted_lists(classes: DataFrame, threshold: float) -> DataFrame:
    """(v, df, node, n): per class its rarest retained values, common ones left out as far as the guarantee allows; df classes retain v."""
    postings = classes.select("node", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("v"))
    shared = postings.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    size = F.least(F.col("n"), F.lit(INDEX))
    # sets whose partners are no larger than the index are known whole on both sides
    whole = math.floor(INDEX * threshold)
    need = F.when(F.col("n") <= whole, F.ceil(F.col("n") * threshold - 1e-9)).otherwise(least_overlap(INDEX, threshold))
    ranked = postings.join(shared, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values that stand in one class only come first in the order and meet nobody
    room = size - need + 1 - (size - F.size("vs"))
    lists = ranked.where(room > 0).select("node", "n", F.explode(F.slice("vs", F.lit(1), room.cast("int"))).alias("x"))
    return materialise(lists.select(F.col("x.v").alias("v"), F.col("x.df").alias("df"), "node", "n"), "near-lists")


def _sizes_fit(na, nb, threshold: float):
    return (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)


def candidate_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, na, b, nb): all of each short list, and the members of each long one with its two hubs as b. The hubs are
    its first and last member in one order of all documents: lists with much the same members have the same hubs."""
    who = F.struct(F.xxhash64("node").alias("h"), "node", "n")
    small = lists.where(F.col("df") <= SHORT).groupBy("v").agg(F.sort_array(F.collect_list(who)).alias("m"))
    both = "flatten(transform(m, (x, i) -> transform(slice(m, 1, i), y -> struct(x.node as a, x.n as na, y.node as b, y.n as nb))))"
    small = small.select(F.explode(F.expr(both)).alias("p")).select("p.*")
    long = lists.where(F.col("df") > SHORT)
    hubs = long.groupBy("v").agg(F.min(who).alias("x"), F.max(who).alias("y"))
    # written first: a join of two tables lets a hot list be split, one above an aggregation doesn't
    hubs = materialise(hubs.select("v", F.explode(F.array("x", "y")).alias("hub")), "near-hubs", short=True)
    held = long.join(hubs, "v").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"))
    fit = _sizes_fit(F.col("na"), F.col("nb"), threshold) & (F.col("a") != F.col("b"))
    pairs = materialise(small.union(held).where(fit).distinct(), "near-pairs", short=True)
    discard(hubs)
    return pairs


def full_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, members): the full shingle sets of the named documents, read from their texts again (by shuffle at every size, for the
    documents named grow with the corpus)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(ids.hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "members"])

    return materialise(texts.mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, members binary"), "near-sets")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """Links (a, b) among pairs: union-sketch estimate, then exact Jaccard on full sets."""
    percent = round(100 * threshold)
    sketch = classes.select("node", "sketch")
    both = pairs.join(sketch.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    # the least K of the union lie in the sketches; those of them in both sketches are common
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    small = (F.col("na") <= K) & (F.col("nb") <= K)
    whole = F.size(F.array_intersect("sa", "sb"))
    exact = 100 * whole >= percent * (F.col("na") + F.col("nb") - whole)
    likely, some = counted(both.where(F.when(small, exact).otherwise(common >= least_overlap(K, threshold))).select("a", "b", (~small).alias("unsure")), "near-likely", F.col("unsure"))
    sure, unsure = likely.where("not unsure").select("a", "b"), likely.where("unsure").select("a", "b")
    if not some:
        return sure

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                n = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * n >= percent * (len(s) + len(t) - n) and n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    id_type = pairs.schema["a"].dataType.simpleString()
    full = full_sets(unsure.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, id_col, text_col, words)
    # members first: a hub's set then meets the rows that carry its members' sets, and travels once
    joined = unsure.join(full.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    checked = joined.select("a", "b", "ma", "mb").mapInArrow(verify, f"a {id_type}, b {id_type}")
    links = materialise(sure.union(checked), "near-links")
    discard(likely, full)
    return links


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task, contracted: every node u beside the least node v that they tie it to."""
    root: dict = {}
    kind = None

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def out() -> Iterator[pa.RecordBatch]:
        tied = [(x, r) for x in root if (r := find(x)) != x]
        if tied:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*tied)], names=["u", "v"])
        root.clear()

    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root.setdefault(x, x)
            root.setdefault(y, y)
            a, c = find(x), find(y)
            if a != c:
                root[max(a, c)] = min(a, c)
        if len(root) > NODES:
            yield from out()
    yield from out()


def components(links: DataFrame) -> DataFrame:
    """(node, part) for every node of links (a, b): part is the least node of its component."""
    tied = trees(links)
    return tied.union(tied.select("part", "part").distinct())


def trees(links: DataFrame) -> DataFrame:
    """(node, part) for every node of links (a, b) that isn't the least of its component; part is that least node.

    Each round contracts the links inside every task and then ties all that a node is tied to, to the least of them, until
    every node is tied to one. After the contraction a node has at most one row a task, so no node is hot. The trees that are
    left are flattened by doubling. Every round is written to the shared folder.
    """
    kind = links.schema["a"].dataType.simpleString()
    e = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    beside = Window.partitionBy("u").orderBy("v")
    while True:
        tied = e.select("u", "v").mapInArrow(_stars, f"u {kind}, v {kind}")
        tied = tied.select("u", "v", F.first("v").over(beside).alias("m"), F.lag("v").over(beside).alias("before"))
        first = F.col("before").isNull()
        tied = tied.where(first | ((F.col("v") != F.col("before")) & (F.col("v") != F.col("m"))))
        done = e
        e, more = counted(tied.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (~first).alias("met")), "near-ties", F.col("met"), short=True)
        if done.columns != ["u", "v"]:
            discard(done)
        if not more:
            break
    while True:
        up = e.select(F.col("u").alias("v"), F.col("v").alias("w"))
        done = e
        e, more = counted(e.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("met")), "near-parts", F.col("met"), short=True)
        discard(done)
        if not more:
            return e.select(F.col("u").alias("node"), F.col("v").alias("part"))


def open_lists(lists: DataFrame, parts: DataFrame) -> tuple[DataFrame, int]:
    """What the hubs left undecided: (v, node, n, part) of long lists that hold more than one component, and whether there are any.
    Lists that have both hubs in common hold much the same members and are taken together; a document has INDEX lists at
    most, so lists never join up beyond that."""
    named = lists.where(F.col("df") > SHORT).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    order = F.xxhash64("node")
    about = named.groupBy("v").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(order).alias("x"), F.max(order).alias("y"))
    undecided, some = counted(about.where("lo <> hi").select("v", F.xxhash64("x", "y").alias("g")), "near-undecided", short=True)
    return named.join(undecided, "v").select(F.col("g").alias("v"), "node", "n", "part").distinct(), some


def block_links(left: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """Links between components (a, b) that meet in open lists, found exactly and without a row a pair.

    A list's members are dealt into bounded blocks, blocks of one component apart from mixed ones; each pair of blocks
    that can hold a link goes to one task, which gets all intersection sizes by matrix products and returns a spanning
    forest of the links. Work grows with the square of the blocks that one list fills.
    """
    members = materialise(left, "near-members", short=True)

    def blocks(count, total):
        return F.greatest(F.ceil(count / BLOCK_DOCS), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")

    parts = members.groupBy("v", "part").agg(F.count("*").alias("pc"), F.sum("n").alias("pn"))
    parts = parts.withColumn("pure", (F.col("pc") * 2 >= BLOCK_DOCS) | (F.col("pn") * 2 >= BLOCK_SHINGLES))
    mixed = parts.where("not pure").groupBy("v").agg(blocks(F.sum("pc"), F.sum("pn")).alias("mb"))
    dealt = parts.join(mixed, "v", "left").select("v", "part", "pure", F.when(F.col("pure"), blocks(F.col("pc"), F.col("pn"))).otherwise(F.col("mb")).alias("nb"))
    dealt = materialise(dealt, "near-dealt", short=True)
    block = F.when(F.col("pure"), F.struct(F.col("part").alias("of"), F.pmod(F.xxhash64("node"), "nb").cast("int").alias("no"))).otherwise(
        F.struct(F.lit(None).cast(members.schema["part"].dataType).alias("of"), F.pmod(F.xxhash64("part"), "nb").cast("int").alias("no"))
    )
    placed = materialise(members.join(dealt, ["v", "part"]).select("v", "node", "part", block.alias("block")), "near-placed", short=True)
    held = materialise(placed.groupBy("v").agg(F.sort_array(F.collect_set("block")).alias("bs")), "near-blocks", short=True)
    sets = full_sets(placed.select(F.col("node").alias("id")).distinct(), docs, id_col, text_col, words).withColumnRenamed("id", "node")
    meets = """transform(filter(transform(bs, (y, j) -> struct(cast(j + 1 as bigint) as j, y as y)), z ->
        block.of is null or z.y.of is null or block.of <> z.y.of), z -> z.j)"""
    sent = placed.join(held, "v").select("v", "node", "part", F.array_position("bs", F.col("block")).alias("i"), F.explode(F.expr(meets)).alias("j"))
    sent = sent.select(F.struct("v", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).alias("pair"), (F.col("i") > F.col("j")).cast("int").alias("side"), "part", "node")
    sent = sent.join(sets, "node").select(F.xxhash64("pair").alias("key"), "pair", "side", "part", "members")
    percent, part_type = round(100 * threshold), members.schema["part"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(3).type
                yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())

        for _, some in itertools.groupby(rows(), key=lambda r: (r[0]["v"], r[0]["lo"], r[0]["hi"])):
            sides: tuple[list, list] = ([], [])
            for _, side, part, blob in some:
                sides[side].append((part, np.frombuffer(blob, np.int64)))
            edges = _forest(sides[0], sides[1] or sides[0], percent)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*edges)], names=["a", "b"])

    dealt_out = sent.repartition("key").sortWithinPartitions("key", "pair", "side")
    found = materialise(dealt_out.mapInArrow(run, f"a {part_type}, b {part_type}"), "near-block-links")
    discard(members, dealt, placed, held, sets)
    return found


def _forest(one: list, two: list, percent: int) -> list[tuple]:
    """Edges of a spanning forest of the links between members (part, set) of different parts in one and two."""
    na, nb = (np.array([len(s) for _, s in side]) for side in (one, two))
    va, vb = (np.concatenate([s for _, s in side]) for side in (one, two))
    ra, rb = (np.repeat(np.arange(len(n)), n) for n in (na, nb))
    common = np.intersect1d(va, vb) if one is not two else np.unique(va)
    ca, cb = (np.searchsorted(common, v) for v in (va, vb))
    inter = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(common), 2048):
        width = min(2048, len(common) - at)
        x, y = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        for m, c, r, v in ((x, ca, ra, va), (y, cb, rb, vb)):
            here = (c >= at) & (c < at + width)
            here[here] = common[c[here]] == v[here]
            m[r[here], c[here] - at] = 1
        inter += x @ y.T
    i, j = np.nonzero((100 * inter.astype(np.int64) >= percent * (na[:, None] + nb[None, :] - inter.astype(np.int64))) & (inter > 0))
    names = sorted({p for p, _ in one} | {p for p, _ in two})
    number = {p: k for k, p in enumerate(names)}
    pa_, pb_ = np.array([number[p] for p, _ in one]), np.array([number[p] for p, _ in two])
    pairs = np.unique(np.stack([pa_[i], pb_[j]], 1), axis=0)
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for p, q in pairs.tolist():
        a, b = find(p), find(q)
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((names[p], names[q]))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links) and kept, a row per row of docs."""
    small_batches(docs.sparkSession)
    signed = signatures(docs, id_col, text_col, words)
    named = signed.where("id is not null and digest is not null")
    grouped = named.groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("x")).select("digest", F.col("x.id").alias("node"), F.col("x.n").alias("n"), F.col("x.sketch").alias("sketch"))
    classes = materialise(grouped, "near-classes")
    lists = inverted_lists(classes, threshold)
    pairs = candidate_pairs(lists, threshold)
    links = confirm(pairs, classes, docs, id_col, text_col, words, threshold)
    parts = trees(links)
    left, some = open_lists(lists, parts)
    if some:
        # what the blocks tie together are components already, so those are contracted further
        more, known = block_links(left, docs, id_col, text_col, words, threshold), parts
        parts = trees(more.union(known))
        discard(more, known)
    discard(lists, pairs, links)
    of_class = classes.select("digest", "node").join(parts, "node", "left").select("digest", F.coalesce("part", "node").alias("part"))
    of_class = materialise(of_class, "near-component", short=True)
    discard(classes, parts)
    out = signed.select("id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("part", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each component; same columns."""
    dropped = near_duplicates(docs, id_col, text_col, words, threshold).where("not kept").select(F.col("id").alias(id_col)).distinct()
    return docs.join(materialise(dropped, "near-dropped"), id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def components_query(docs: DataFrame) -> DataFrame:
    """The contract's columns per document: shingles of four words."""
    found = near_duplicates(docs.select("doc_id", "text"), words=4)
    return found.withColumnRenamed("id", "doc_id")


#: Every pair of documents sharing a shingle is counted, so this is for small tables only.
COMPONENTS_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) end as sh
  from w),
u as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (
  select x, y from p join s a on a.doc_id = x join s b on b.doc_id = y where 100 * i >= 80 * (len(a.sh) + len(b.sh) - i)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as reached from documents union select r.doc_id, e.y from r join e on e.x = r.reached)
select r.doc_id, any_value(len(s.sh))::bigint as n_shingles, min(reached) as component_id, min(reached) = r.doc_id as kept
from r join s on s.doc_id = r.doc_id group by r.doc_id
"""
