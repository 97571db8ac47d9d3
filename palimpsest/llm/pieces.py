"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model spans a whitespace marker that follows other characters, nor a line feed (both are
checked when the model is loaded), so segmentation never crosses the start of a marked word. The texts of a
batch are cut into marked words, the distinct ones that a task's table lacks are segmented at once, and ids and
surfaces are joined back by position. The table lives as long as the task's Python worker. It is bounded: when its
younger half is full, the older half is forgotten, and words that are met again move to the younger one, so
words in steady use are segmented once. A model that fails the check is used on whole texts.

Null text counts as empty: no ids, empty decoding. Texts of any length are encoded whole; a long word is segmented like
any other but not kept in the table. Rows, repeated ones too, are encoded one by one; other columns pass through, and
one called like the new one, in whatever case, is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.shared import append_columns

MARK = "▁"


class ChunkCodec:
    """Ids and surfaces of distinct chunks, max_chunks of them at most between two batches (some 150 bytes each)."""

    def __init__(self, model_file: str, max_chunks: int = 600_000, longest_kept: int = 64):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.max_chunks, self.longest = max_chunks, longest_kept
        kinds = range(self.sp.get_piece_size())
        plain = [self.sp.id_to_piece(i) for i in kinds if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        probe = " a  b\n\nc d　eﬁ Å"
        self.separable = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
            and not any(self.sp.is_unused(i) for i in kinds)
            and self.sp.decode(self.sp.encode(probe)) == probe
            and self.sp.encode("a", out_type=str)[0].startswith(MARK)
        )
        self.split = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n+")
        self.lead, self.lone_mark = self.sp.encode("\n"), [self.sp.piece_to_id(MARK)]
        self.surface = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, self.sp.id_to_piece(i)) for i in kinds)]
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def _segmented(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Rows of distinct chunks: number of ids, decimal ids joined by commas, surface. The library puts a marker before whatever it
        is given, so a chunk that begins with markers gives one away and any other is encoded behind a line feed, whose ids are dropped."""
        marked = [c[0] in f" {MARK}" for c in chunks]
        found = self.sp.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)], num_threads=1)
        rows = []
        for m, ids in zip(marked, found):
            ids = (ids or self.lone_mark) if m else ids[len(self.lead) :]
            surface = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
            rows.append((len(ids), ",".join(map(str, ids)), surface))
        return rows

    def rows(self, cut: list[list[str]]) -> list[list[tuple[int, str, str]]]:
        """The rows of each text's chunks, by position."""
        young, old = self.young, self.old
        lacking = set().union(*cut)
        lacking.difference_update(young)
        again = lacking & old.keys()
        young.update((c, old[c]) for c in again)
        lacking -= again
        new = list(lacking)
        young.update(zip(new, self._segmented(new)))
        out = [[young[c] for c in chunks] for chunks in cut]
        for c in new:
            if len(c) > self.longest:
                del young[c]
        if len(young) > self.max_chunks // 2:
            self.young, self.old = {}, young
        return out

    def parts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, decimal ids joined by commas, and what those ids decode to, all from the table."""
        if not self.separable:
            whole = [self.sp.encode(t) if t else [] for t in texts]
            return [(len(ids), ",".join(map(str, ids)), self.decode(ids)) for ids in whole]
        rows = self.rows([self.split.findall(" " + t) if t else [] for t in texts])
        return [(sum([r[0] for r in some]), ",".join([r[1] for r in some]), "".join([r[2] for r in some])[1:]) for some in rows]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for i in ids.split(",")] if n else [] for n, ids, _ in self.parts(texts)]

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> ChunkCodec:
    return ChunkCodec(model_file)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, text_col: str = "text", out_col: str = "ids", model_file: str | None = None) -> DataFrame:
    """df with an array of piece ids per row; a column already called out_col is replaced."""
    model = model_file or default_model()
    return append_columns(df, text_col, lambda texts: [pa.array(codec(model).encode(texts), pa.list_(pa.int32()))], [(out_col, "array<int>")])


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "text", model_file: str | None = None) -> DataFrame:
    """df with the decoded text of each id array; null or empty arrays give the empty text."""
    model = model_file or default_model()
    return append_columns(df, ids_col, lambda rows: [pa.array([codec(model).decode(ids) for ids in rows], pa.string())], [(out_col, "string")])


def digest_query(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """The contract's columns per document."""
    model = model_file or default_model()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def made(texts: list) -> list[pa.Array]:
        rows = [(n, sha(joined), sha(decoded)) for n, joined, decoded in codec(model).parts(texts)]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]

    columns = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return append_columns(docs.select("doc_id", "text"), "text", made, columns, drop_source=True)
