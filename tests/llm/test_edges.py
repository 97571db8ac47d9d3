"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names and text ids."""

import pytest

from palimpsest.llm import chat, exact, extract, lines, merkle, near, packing, pieces, pii, quality

LONG = "x" * 1_000_000
TEXTS = [None, "", " \n\t ", LONG, "tie", "tie", "Tie!", "\n" * 5000, "word " * 20000, "last"]
#: Names that operators use or make, in either case.
CLASH = ["pii", "PII", "score", "fingerprint", "ids", "digest", "n", "kept", "__text", "__Source", "__line_text", "__line_doc", "__locator_file", "__locator_row", "file", "row", "norm", "part", "key"]


def table(spark, ids, text="text", id_col="doc_id"):
    """Null, repeated and ordinary ids over the odd texts, the last row twice, beside clashing columns (one of each, whatever its case)."""
    names = list({c.lower(): c for c in CLASH if c.lower() not in (text, id_col)}.values())
    key = (lambda i: None if i == 6 else i // 2 * 2 if i < 4 else i) if ids == "bigint" else (lambda i: None if i == 6 else f"d{i}")
    rows = [(key(i), t, *(f"own {c} {i}" for c in names)) for i, t in [*enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1])]]
    return spark.createDataFrame(rows, f"{id_col} {ids}, {text} string, " + ", ".join(f"`{c}` string" for c in names)), names


def through(df, out, names, made=()):
    """Columns pass through untouched but for those made."""
    made = {m.lower() for m in made}
    assert [c for c in out.columns if c.lower() not in made] == [c for c in df.columns if c.lower() not in made]
    left = [c for c in names if c.lower() not in made]
    pick = lambda d: sorted(map(str, d.select(*[f"`{c}`" for c in left]).collect()))
    assert set(pick(out)) <= set(pick(df))
    return out.collect()


RUNS = {
    "quality": lambda d, s: (quality.score(d, quality.Net.fresh(1)), ["score"], None),
    "merkle": lambda d, s: (merkle.with_fingerprint(d), ["fingerprint"], None),
    "exact": lambda d, s: (exact.deduplicate(d), [], 6),
    "pii": lambda d, s: (pii.detect(d), ["pii"], None),
    "redact": lambda d, s: (pii.redact(d), [], None),
    "lines": lambda d, s: (lines.deduplicate_lines(d), [], None),
    "extract": lambda d, s: (extract.extract(d, "text", "ids"), ["ids", "text"], None),
    "pieces": lambda d, s: (pieces.encode(d), ["ids"], None),
}


@pytest.mark.parametrize("ids", ["bigint", "string"])
@pytest.mark.parametrize("name", sorted(RUNS))
def test_operators_that_keep_rows(spark, name, ids):
    df, names = table(spark, ids)
    out, made, left = RUNS[name](df, spark)
    assert len(through(df, out, names, made)) == (left or len(TEXTS) + 1)
    assert RUNS[name](df.limit(0), spark)[0].count() == 0


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_operators_that_make_rows(spark, ids):
    df, names = table(spark, ids)
    n = len(TEXTS) + 1
    groups = exact.groups(df).collect()
    assert len(groups) == n and sum(r.kept for r in groups) == 6 and {r.group_size for r in groups if r.id is None} == {1}
    found = near.near_duplicates(df, words=4).collect()
    assert len(found) == n and all(r.kept for r in found if r.id is None)
    kept = near.deduplicate(df)
    through(df, kept, names)
    pieces_ = packing.pack(df.where("text is null or length(text) < 1000"), length=64).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces_}) == len(pieces_) and sum(r.start == 0 for r in pieces_) == 8
    assert merkle.edited_query(df).count() == n and merkle.edited_query(df.limit(0)).count() == 0
    assert exact.groups(df.limit(0)).count() == near.near_duplicates(df.limit(0)).count() == packing.pack(df.limit(0)).count() == 0


def test_conversations(spark):
    df, names = table(spark, "bigint", "text", "conv_id")
    rows = df.withColumnRenamed("n", "turn").withColumnRenamed("kept", "role").selectExpr("* except (turn)", "cast(substr(turn, -1, 1) as bigint) as turn")
    out = chat.format_rows(rows).collect()
    assert sum(len(chat.read_back(r.formatted)) for r in out) == len(TEXTS) + 1
    assert chat.format_rows(rows.limit(0)).count() == 0


def test_train_on_odd_rows(spark):
    df, _ = table(spark, "bigint")
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (4, None), (None, 1), (8, 7)], "doc_id bigint, quality int")
    assert quality.score(df, quality.train(df, labels)).count() == len(TEXTS) + 1
