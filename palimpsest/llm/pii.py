"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are found exactly as their patterns say, leftmost and without
overlaps inside a kind, and always kept. Further kinds (iban, ssn, local_phone) are proposed by
patterns, confirmed by a checksum where one exists, and kept when their score, raised by context
words close by, reaches the threshold and they overlap no base span.

Null or empty text has no spans; texts of any length are read whole. Offsets are code points, ends exclusive. Spans that
tie on their start stand in the order of kinds. Rows, repeated ones too, keep their other columns; one called like a new
column, in whatever case, is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import append_columns

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "ssn", "local_phone")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + EXTRA_KINDS)}
SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_CONTEXT = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|sozialversicherung)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|teléfono|téléphone)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon)\b", re.I),
    "email": re.compile(r"\b(?:mail|email|contact)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
}
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Walk the '@' signs: each owns the run of local-part characters before it, so long runs cost once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _octets(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _scored(text: str, kind: str, start: int, end: int, window: int) -> Span:
    near = text[max(0, start - window) : start] + " " + text[end : end + window]
    return Span(kind, start, end, min(1.0, _PRIOR[kind] + (0.3 if _CONTEXT[kind].search(near) else 0.0)))


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as ordered pieces that don't overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_spans(text: str | None, threshold: float = 0.6, window: int = 48) -> list[Span]:
    """All spans of one whole text, by start and then kind."""
    if not text:
        return []
    base: list[tuple[str, int, int]] = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    extra: list[Span] = []
    if _DIGIT.search(text):
        base += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        base += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            base += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
        proposed = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0])]
        proposed += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        proposed += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        taken = _merged(base)
        for kind, s, e in proposed:
            at = bisect_left(taken, (e,))  # the last one that begins before e
            if at == 0 or taken[at - 1][1] <= s:
                span = _scored(text, kind, s, e, window)
                if span.score >= threshold:
                    extra.append(span)
                    taken.insert(at, (s, e))
    spans = [_scored(text, k, s, e, window) for k, s, e in base] + extra
    return sorted(spans, key=lambda x: (x.start, ORDER[x.kind]))


def _join(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(df: DataFrame, text_col: str = "text", out_col: str = "pii", threshold: float = 0.6, window: int = 48) -> DataFrame:
    """df with an array of scored spans per row; a column already called out_col is replaced."""
    return append_columns(df, text_col, lambda texts: [pa.array([[x._asdict() for x in find_spans(t, threshold, window)] for t in texts], _SPAN_ARROW)], [(out_col, SPAN_TYPE)])


def redact_text(text: str | None, threshold: float = 0.6, window: int = 48) -> str | None:
    """The text with each span (overlapping ones merged) replaced by <KIND>."""
    spans = find_spans(text, threshold, window)
    if not spans:
        return text
    out, at = [], 0
    for i, x in enumerate(spans):
        if x.start >= at:
            out += [text[at : x.start], f"<{x.kind.upper()}>"]
        at = max(at, x.end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", threshold: float = 0.6, window: int = 48) -> DataFrame:
    """df with text_col redacted, same columns in the same order; null stays null."""
    done = append_columns(df, text_col, lambda texts: [pa.array([redact_text(t, threshold, window) for t in texts], pa.string())], [(text_col, "string")])
    return done.select(*[F.col(f"`{c}`") for c in df.columns])


def digest_query(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""

    def made(texts: list) -> list[pa.Array]:
        counts, digests, joined = [[] for _ in BASE_KINDS], [], []
        for t in texts:
            spans = find_spans(t)
            base = [x for x in spans if x.kind in BASE_KINDS]
            for k, out in zip(BASE_KINDS, counts):
                out.append(sum(x.kind == k for x in base))
            digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
            joined.append(_join(spans))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())]

    columns = [*((f"n_{k}", "bigint") for k in BASE_KINDS), ("base_sha256", "string"), ("spans", "string")]
    return append_columns(docs.select("doc_id", "text"), "text", made, columns, drop_source=True)
