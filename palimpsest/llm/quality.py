"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each
chunk's byte embeddings and an echo channel (do the last eight bytes repeat what stood up to ECHO bytes
before?) and are max-pooled, a small layer turns the pooled values into chunk features, and the
features' maximum and mean over all chunks give one probability. Training happens here, by Adam, on a
bounded sample of labelled rows (PER_CLASS of each label, chosen by a hash of the id); training and scoring both
read whole texts, a bounded number of chunks at a time.

Only text is an input of a score. Null and empty texts are one chunk of padding and get a score as well; texts may be of
any length. An id with both labels is not learned from; of rows that share an id one is. With labels of one kind only,
every score is that label; with none it is 0.5. An empty table gives no rows; other columns pass through, and one called
like the new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.shared import append_columns, fresh

#: Bound of the training sample: documents a label.
PER_CLASS = 1500
#: Chunks convolved at a time.
BLOCK = 48
CHUNK, STEP = 512, 384
WIDTH, DIM, FILTERS, HIDDEN, ECHO = 7, 4, 16, 12, 32
ROW = WIDTH * (DIM + 1)
THRESHOLD = 0.3


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks (rows of CHUNK bytes, zero-padded) covering all of data; at least one."""
    n = max(1, -(-max(0, len(data) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def echo(chunks: np.ndarray) -> np.ndarray:
    """1 where the eight bytes up to here also stood 2 to ECHO bytes before, else 0; padding never echoes."""
    found = np.zeros(chunks.shape, bool)
    for lag in range(2, ECHO + 1):
        m = chunks[:, lag:] == chunks[:, :-lag]
        for k in (1, 2, 4):
            m = m[:, k:] & m[:, :-k]
        found[:, lag + 7 :] |= m
    return (found & (chunks != 0)).astype(np.float32)


@dataclass
class Net:
    """emb (256, DIM), conv (ROW, FILTERS), conv_b, hid (FILTERS, HIDDEN), hid_b, out (2*HIDDEN,), out_b (1,); constant overrides all."""

    p: dict[str, np.ndarray]
    constant: float | None = None

    @staticmethod
    def fresh(seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        shapes = {"emb": (256, DIM), "conv": (ROW, FILTERS), "conv_b": (FILTERS,), "hid": (FILTERS, HIDDEN), "hid_b": (HIDDEN,), "out": (2 * HIDDEN,), "out_b": (1,)}
        scale = {"emb": 0.7, "conv": (2 / ROW) ** 0.5, "hid": (2 / FILTERS) ** 0.5, "out": HIDDEN**-0.5}
        return Net({k: (r.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in shapes.items()})

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        e = np.concatenate([self.p["emb"][chunks], echo(chunks)[:, :, None]], 2)
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)
        return w.transpose(0, 1, 3, 2).reshape(-1, ROW)

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Max-pooled filter responses of each chunk, and their positions if asked for."""
        tops, places = [], []
        for at in range(0, len(chunks), BLOCK):
            some = chunks[at : at + BLOCK]
            a = (self.windows(some) @ self.p["conv"]).reshape(len(some), CHUNK - WIDTH + 1, FILTERS)
            tops.append(a.max(1) + self.p["conv_b"])
            if where:
                places.append(a.argmax(1))
        return (np.concatenate(tops), np.concatenate(places)) if where else np.concatenate(tops)

    def features(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.p["hid"] + self.p["hid_b"], 0)

    def scores(self, texts: list[str | None], block: int = BLOCK) -> np.ndarray:
        """One probability per text, a bounded number of chunks at a time."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best = np.full((len(texts), HIDDEN), -np.inf, np.float32)
        total = np.zeros((len(texts), HIDDEN))
        count = np.zeros(len(texts))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            h, own = self.features(self.pooled(np.concatenate(held))), np.array(owner)
            np.maximum.at(best, own, h)
            np.add.at(total, own, h)
            np.add.at(count, own, 1)
            held.clear()
            owner.clear()

        for i, t in enumerate(texts):
            c = chunks_of((t or "").encode())
            for at in range(0, len(c), block):
                part = c[at : at + block]
                held.append(part)
                owner += [i] * len(part)
                if len(owner) >= block:
                    flush()
        if owner:
            flush()
        z = np.concatenate([best, total / np.maximum(count, 1)[:, None]], 1) @ self.p["out"] + self.p["out_b"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(samples: list[tuple[int, bytes]], epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Net:
    """Train on (label, UTF-8 text) pairs; classes weigh the same."""
    net = Net.fresh(seed)
    labels = np.array([y for y, _ in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        net.constant = float(labels[0]) if len(labels) else 0.5
        return net
    share = labels.mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    r = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    epochs = max(epochs, min(120, -(-12_000 // len(samples))))
    steps, step = epochs * -(-len(samples) // batch), 0
    for _ in range(epochs):
        order = r.permutation(len(samples))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            grads = _gradients(net, [chunks_of(samples[i][1]) for i in some], labels[some], weight[some])
            step += 1
            now = rate * min(1.0, step / 20) * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g + 1e-4 * net.p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def _gradients(net: Net, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    chunks = np.concatenate(docs)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    pooled, where = net.pooled(chunks, True)
    lit = np.maximum(pooled, 0)
    h = np.maximum(lit @ net.p["hid"] + net.p["hid_b"], 0)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])[:-1]))
    best, mean = np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / np.array([len(d) for d in docs])[:, None]
    both = np.concatenate([best, mean], 1).astype(np.float32)
    p = 1 / (1 + np.exp(-np.clip(both @ net.p["out"] + net.p["out_b"], -30, 30)))
    dz = ((p - labels) * weight / len(docs)).astype(np.float32)
    g = {"out": both.T @ dz, "out_b": np.array([dz.sum()], np.float32)}
    dboth = dz[:, None] * net.p["out"]
    is_best = h == best[owner]
    is_best &= np.cumsum(is_best, 0) - np.concatenate([np.zeros((1, HIDDEN), int), np.cumsum(is_best, 0)])[starts][owner] == 1
    sizes = np.array([len(d) for d in docs], np.float32)
    dh = (dboth[owner, :HIDDEN] * is_best + dboth[owner, HIDDEN:] / sizes[owner][:, None]) * (h > 0)
    g["hid"], g["hid_b"] = lit.T @ dh, dh.sum(0)
    dtop = (dh @ net.p["hid"].T) * (pooled > 0)
    g["conv_b"] = dtop.sum(0)
    at = where[:, :, None] + np.arange(WIDTH)  # chunk, filter, tap
    seen = chunks[np.arange(len(chunks))[:, None, None], at]
    echoes = echo(chunks)[np.arange(len(chunks))[:, None, None], at]
    inputs = np.concatenate([net.p["emb"][seen], echoes[..., None]], 3).reshape(len(chunks), FILTERS, ROW)
    g["conv"] = np.einsum("cfk,cf->kf", inputs, dtop)
    demb = (dtop[:, :, None] * net.p["conv"].T[None]).reshape(-1, DIM + 1)
    flat = seen.reshape(-1)
    g["emb"] = np.stack([np.bincount(flat, demb[:, d], 256) for d in range(DIM)], 1).astype(np.float32)
    return g


# ---- tables -----------------------------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Fit on labelled rows that aren't held out. At most 2 * PER_CLASS texts reach the driver, one of each id."""
    y = F.col(label_col).cast("int")
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), y.alias("y")).where("y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for y in (0, 1)]
    # at most 2 * PER_CLASS ids, so this may be broadcast at every size
    chosen = F.broadcast(picked[0].union(picked[1]))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(chosen, "id")
    rows = src.groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return fit([(r.y, r.text.encode()) for r in sorted(rows, key=lambda r: r.id)])


def score(docs: DataFrame, net: Net, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the probability of label 1; a column already called out_col is replaced."""
    return append_columns(docs, text_col, lambda texts: [pa.array(net.scores(texts), pa.float64())], [(out_col, "double")])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; same columns."""
    name = fresh(docs, "__score")
    scored = score(docs, train(docs, labels), out_col=name)
    return scored.where(F.col(name) >= threshold).drop(name)


def scores_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    net = train(docs, labels)
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
