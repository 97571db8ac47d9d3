"""Packing by concatenate and cut.

Pass one tokenises each document once and writes ids with their offset inside their partition. The
partitions' token totals (one number each) turn into prefix sums, which give every document its place in
one long stream of ids. Pass two cuts the stream at multiples of the sequence length: a document that
crosses a cut gives one boundary record a window. Only the last sequence is short.

Null text counts as empty: such a document holds its end id alone. A text of any length is tokenised whole, and its pieces
may fill many sequences. Repeated rows and rows of equal or null ids are documents of their own. Only the id and text
columns are read, so others may have any name. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import materialise, small_batches

class ByteBpe:
    """Ids of a byte-level BPE: the rank form of the vocabulary is quick, the JSON form settles texts that hold special tokens
    and those that the quick one gives up on (its pattern matcher runs out of stack within very long runs of one kind)."""

    def __init__(self, json_file: str, rank_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_file)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def _bpe(json_file: str, rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_file, rank_file, pattern)


def default_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str, str] | None = None, end_id: int = 1) -> DataFrame:
    """Per document: its id, partition, token offset inside the partition, token count and ids (little-endian unsigned 16 bit
    where the vocabulary allows, else 32), the end id included. Rows are written to the shared folder."""
    files = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = _bpe(*files), TaskContext.get().partitionId(), 0
        kind = np.uint16 if max(bpe.full.get_vocab_size(), end_id + 1) <= 65536 else np.uint32
        for b in batches:
            starts, counts, blobs = [], [], []
            for t in b.column(1).to_pylist():
                ids = np.append(bpe.ids(t) if t else np.empty(0, np.uint32), np.uint32(end_id)).astype(kind)
                starts.append(at)
                counts.append(len(ids))
                blobs.append(ids.tobytes())
                at += len(ids)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([kind().itemsize] * n, pa.int32()), pa.array(blobs, pa.binary())],
                names=["id", "part", "local", "n", "width", "ids"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return materialise(src.mapInArrow(run, f"id {id_type}, part int, local bigint, n bigint, width int, ids binary"), "tokens")


def place(tokens: DataFrame) -> DataFrame:
    """tokens with `start`, each document's offset in the whole stream. One number a partition reaches the driver."""
    spark = tokens.sparkSession
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = itertools.accumulate((n for _, n in totals), initial=0)
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, base bigint")
    # a row a task of the first pass (16 bytes), which the driver holds anyway: broadcast at every size
    return tokens.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("local"))


def cut(placed: DataFrame, length: int = 2048) -> DataFrame:
    """One row per piece: id, start (the document's ids before it), length, ids (little-endian unsigned 32 bit), crc32, doc_tokens,
    sequence_id and offset."""
    if length < 1:
        raise ValueError("length must be positive")
    small_batches(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            rows = zip(*(b.column(i).to_pylist() for i in range(5)))
            for key, start, n, width, blob in rows:
                ids = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32).astype("<u4")
                at = 0
                while at < n:
                    seq, off = divmod(start + at, length)
                    k = min(n - at, length - off)
                    piece = ids[at : at + k].tobytes()
                    out.append((key, at, k, piece, zlib.crc32(piece), n, seq, off))
                    at += k
                if len(out) >= 2000:
                    yield _pieces(out, b.schema.field(0).type)
                    out = []
            if out:
                yield _pieces(out, b.schema.field(0).type)

    def _pieces(out, id_type):
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    id_type = placed.schema["id"].dataType.simpleString()
    ddl = f"id {id_type}, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return placed.select("id", "start", "n", "width", "ids").mapInArrow(run, ddl)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, vocabulary: tuple[str, str, str] | None = None, end_id: int = 1) -> DataFrame:
    return cut(place(tokenise(docs, id_col, text_col, vocabulary, end_id)), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id and ids, joined by offset; a group never holds more than one window."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def digest_query(docs: DataFrame) -> DataFrame:
    """The contract's columns per piece."""
    return pack(docs).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
