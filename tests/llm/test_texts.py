"""Operators that work on one text at a time: brute-force versions, exact round trips, edge cases."""

import hashlib
import html
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, extract, merkle, pieces, pii

EDGES = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "word " * 30000, "x"), (5, "same", "x"), (5, "same", "x"), (None, "no id", "x")]


def edges(spark):
    """Null and repeated ids, null, empty and long texts, and a column whose name the operator uses itself."""
    return spark.createDataFrame([(i, t, s, "clash") for i, t, s in EDGES], "doc_id bigint, text string, source string, {} string".format("pii"))


# ---- personal data


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.BASE_KINDS.index(x[0])))


def test_base_spans_random():
    rng, seen = random.Random(5), 0
    parts = ["a", "@", ".", "b.c", "1", "23", "255", "-", " ", "+", "+1", "4111111111111111", "555", "(", ")", "%", "é", "x@y.z", "1.2.3.4"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 22)))
        got = [tuple(x[:3]) for x in pii.find_spans(t) if x.kind in pii.BASE_KINDS]
        seen += len(got)
        assert got == base_spans(t), t
    assert seen > 5000


def test_long_runs_take_linear_time():
    begun = time.process_time()
    pii.find_spans("call 555-123-4567 now, mail a@b.cd, " * 20000)
    assert time.process_time() - begun < 5
    for t in ("a" * 200000, "1" * 200000, "1." * 100000, "@" * 100000, "+1 " * 60000, "a@" * 60000):
        pii.find_spans(t)


def test_checksums_and_context():
    assert [x.kind for x in pii.find_spans("iban GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert pii.find_spans("GB82 WEST 1234 5698 7654 33") == []
    assert [x.kind for x in pii.find_spans("call 555-123-4567 now")] == ["local_phone"] and pii.find_spans("code 555-123-4567 now") == []
    assert pii.redact_text("mail a.b@c.de or +1 555 123 4567!") == "mail <EMAIL> or <PHONE>!"


def test_pii_tables(spark):
    df = edges(spark)
    assert pii.redact(df).columns == df.columns and pii.redact(df).count() == len(EDGES)
    assert [r.text for r in pii.redact(df).where("doc_id = 1").collect()] == [None]
    assert pii.detect(df).columns == ["doc_id", "text", "source", "pii"]
    q = {r.doc_id: r for r in pii.digest_query(df).collect()}
    assert q[1].base_sha256 == hashlib.sha256(b"").hexdigest() and q[1].spans == "" and q[4].n_email == 0
    assert pii.digest_query(df.limit(0)).count() == 0


# ---- pieces

ALPHABET = " \n\t\r▁ab cTé—ñ😀\x00　ﬁ</s>0.,The  "


def test_pieces_equal_the_library():
    sp, c = pieces.codec(pieces.default_model()).sp, pieces.codec(pieces.default_model())
    assert c.separable
    rng = random.Random(5)
    for _ in range(100):
        some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(50)] + [None]
        ids = [sp.encode(t or "") for t in some]
        assert c.encode(some) == ids and c.parts(some) == [(len(x), ",".join(map(str, x)), sp.decode(x) if x else "") for x in ids], some


def test_distinct_words_are_segmented_once():
    c, seen = pieces.ChunkCodec(pieces.default_model()), []
    segmented = c._segmented
    c._segmented = lambda chunks: seen.extend(chunks) or segmented(chunks)
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(200)]
    assert [x for k in range(0, 200, 20) for x in c.encode(texts[k : k + 20])] == [c.sp.encode(t) for t in texts]
    assert len(seen) == len(set(seen)) == len({w for t in texts for w in t.split()})


def test_words_in_use_stay_in_a_small_table():
    c, seen = pieces.ChunkCodec(pieces.default_model(), max_chunks=60), []
    segmented = c._segmented
    c._segmented = lambda chunks: seen.extend(chunks) or segmented(chunks)
    for k in range(50):
        t = f"steady words come back new{k} other{k}"
        assert c.encode([t]) == [c.sp.encode(t)] and len(c.young) + len(c.old) <= 70
    assert [seen.count(f" {w}") for w in ("steady", "words", "come", "back")] == [1] * 4


def test_small_table_gives_the_same():
    c = pieces.ChunkCodec(pieces.default_model(), max_chunks=3, longest_kept=4)
    t = "one two three one longerword two\nfour five " * 5
    assert c.encode([t]) * 2 == c.encode([t, t]) == [c.sp.encode(t)] * 2 and len(c.young) + len(c.old) <= 12


def test_pieces_tables(spark):
    df = edges(spark)
    back = pieces.decode(pieces.encode(df), out_col="again")
    assert all((r.text or "") == r.again for r in back.collect())
    q = {r.doc_id: r for r in pieces.digest_query(df).collect()}
    assert q[1].n_tokens == 0 and q[2].ids_sha256 == q[1].ids_sha256 and q[4].n_tokens > 20000
    assert pieces.digest_query(df.limit(0)).count() == 0


# ---- fingerprints


def test_trees_random():
    rng = random.Random(3)
    some = lambda: "".join(rng.choice(["word", "a", "b ", "  ", "\n", "é", "x y z ", " ", "r" * 200]) for _ in range(rng.randint(0, 60)))
    for _ in range(1500):
        t, u = some(), some()
        a = merkle.build(t.encode())
        head = t[: len(t) - len(t) // 3]
        e = (head + u[: len(t) // 3]).encode()
        assert merkle.build(e, a, len(head.encode())) == merkle.build(e)
        assert (merkle.fingerprint(u) == a.text()) == (t == u) == (merkle.compare(a.text(), merkle.fingerprint(u)) == 1)
        assert (merkle.differing(a.text(), merkle.fingerprint(t)) == []) and merkle.parse(a.text()).root == a.root


def test_edits_are_located():
    lines = [f"This is paragraph {i} of a text with some words.\n" for i in range(40)]
    a = merkle.fingerprint("".join(lines))
    lines[17] = "Something else stands here now.\n"
    b = merkle.fingerprint("".join(lines))
    assert 1 <= len(merkle.differing(b, a)) <= 2 and merkle.compare(a, b) > 0.9


def test_edited_query(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("ab \né") for _ in range(rng.randint(0, 40))) for i in range(0, 90, 3)} | {1: None, 2: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in merkle.edited_query(df).collect()}
    assert sorted(got) == sorted(texts)
    for i, k in enumerate(order):
        t, u = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == merkle.fingerprint(t) and r.edited_fingerprint == merkle.fingerprint(e)
        assert abs(r.near_next - merkle.compare(r.fingerprint, merkle.fingerprint(u))) < 1e-9


@pytest.mark.parametrize("ids", ["numbers", "texts", "mixed lengths"])
def test_next_document_of_any_id(spark, ids):
    name = {"numbers": lambda i: i * 3, "texts": lambda i: f"doc-{i:05d}", "mixed lengths": lambda i: "é" * (i % 4) + str(i * i)}[ids]
    kind = "bigint" if ids == "numbers" else "string"
    texts = {name(i): f"Text number {i} has some words.\n" * (1 + i % 3) for i in range(50)}
    order = sorted(texts, reverse=True)
    rows = [*texts.items(), (None, "no id")]
    for buckets in (1, 7):
        beside = merkle.beside_next(spark.createDataFrame(rows, f"doc_id {kind}, text string"), buckets=buckets).collect()
        by_bucket = {}
        for r in beside:
            by_bucket.setdefault(r.bucket, []).append(r)
        follows = {a.id: b.id for some in by_bucket.values() for a, b in zip(some, some[1:]) if not a.foreign}
        assert follows == dict(zip([*order, None], [*order[1:], None, order[0]]))


def test_likeness_by_brute_force():
    """Leaves cut and compared by plain loops."""
    space, mask = b" \t\n\x0b\f\r", (1 << 64) - 1

    def leaves(text):
        data, out, start = text.encode(), [], 0
        for i, x in enumerate(data):
            before = int.from_bytes((b"\0" * 8 + data)[i : i + 8], "little")
            end = x == 10 or (x in space and (before * 0x9E3779B97F4A7C15 & mask) >> 63 == 0) or i == len(data) - 1
            if end or i + 1 - start == merkle.LONGEST:
                out.append(hashlib.blake2b(data[start : i + 1], digest_size=16).digest()[:4])
                start = i + 1
        return out

    rng = random.Random(12)
    for _ in range(300):
        t, u = (" ".join(rng.choice(["alpha", "b", "\n", "gamma delta", "é", "x" * 300]) for _ in range(rng.randint(0, 40))) for _ in "tu")
        u = rng.choice([u, t[: len(t) // 2] + u])
        a, b = leaves(t), leaves(u)
        assert merkle.parse(merkle.fingerprint(t)).leaves == a
        if t != u:
            left, same = list(b), 0
            for x in a:
                if x in left:
                    left.remove(x)
                    same += 1
            want = 2 * same / (len(a) + len(b)) if a and b else 0.0
            assert abs(merkle.compare(merkle.fingerprint(t), merkle.fingerprint(u)) - min(want, 0.999999)) < 1e-9


def test_fingerprint_tables(spark):
    assert merkle.edited_query(edges(spark)).count() == len(EDGES)
    assert merkle.edited_query(edges(spark).limit(0)).count() == 0
    one = merkle.edited_query(spark.createDataFrame([(7, "abcdef")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    assert merkle.with_fingerprint(edges(spark), out_col="source").columns == ["doc_id", "text", "pii", "source"]


# ---- main text


def test_minimum_cut_by_enumeration():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randint(1, 8)
        costs = [rng.randint(-9, 9) for _ in range(n)]
        edge = {(j, i): rng.randint(0, 6) for i in range(n) for j in range(i) if rng.random() < 0.5}
        value = lambda x: sum(abs(c) for c, k in zip(costs, x) if (c > 0) != bool(k) and c) + sum(w for (a, b), w in edge.items() if x[a] != x[b])
        assert value(extract.min_cut(costs, edge)) == min(map(value, itertools.product([0, 1], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
<div id="main"><article><h1>Title &amp; more</h1><p>First <b>bold
 text</b>.<br>Next<p>Second &lt;tag&gt; &copy;<ul><li>one<li>two</ul><div class="share"><a href=x>Share</a></div></article>
<section class="comments"><p>Nice post, I liked it very much indeed.</p></section></div>
<aside><p>Side</p></aside><form><p>Sign up</p></form><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE) == "Title & more\nFirst bold text. Next\nSecond <tag> ©\none\ntwo"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<p></p>") == ""
    broken = "<article><p>Text that never ends and has quite a few words in it <b>open"
    assert extract.main_text(broken) == "Text that never ends and has quite a few words in it open"
    long = "<article>" + "<p>word one two three</p>" * 5000 + "</article>"
    assert extract.main_text(long).count("\n") == 4999


def test_broken_markup_keeps_its_text():
    quoted = "<p title=Bob's>First one here.</p><p>I don't know.</p><p>Third one isn't it."
    assert extract.main_text(quoted) == "First one here.\nI don't know.\nThird one isn't it."
    assert extract.main_text("<article><p>1 < 2 and 3 <4 <!> x</p><p a='>' b=\">\" c>y</p></article>") == "1 < 2 and 3 <4 x\ny"
    assert extract.main_text("<article><p>a<!-- x --><!--> b</p><script>if (a</b>) '<p>'</script><p>c") == "a b\nc"


@pytest.mark.parametrize("page", ["<a " * 350_000, "<" * 1_000_000, "<a x='" * 170_000, "<!--" * 250_000, "<svg>" * 200_000, "</p " * 250_000, "<p>x" * 20_000, "x" * 1_000_000])
def test_long_pages_take_linear_time(page):
    begun = time.process_time()
    extract.main_text(page)
    assert time.process_time() - begun < 4


ARTICLE = ["A heading of this page", "The first paragraph is long enough to speak for itself, as it has many words and a full stop.", "Short.", "The second long paragraph follows after a short one, and it too has many words and a full stop.", "No stop"]


@pytest.mark.parametrize("around", [("<article>", "</article>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("<main><section>", "</section></main>"), ("", "")])
def test_cut_corrects_the_classifier(around):
    """Short lines of the text stay and long ones in furniture go, with or without an article element."""
    text = f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{p}</p>" for p in ARTICLE[1:])
    long = "A long sentence that has nothing of furniture in itself, for it is as long and as full as others."
    page = f"""<body><nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav><div class="ad"><p>{long}</p></div>{around[0]}{text}{around[1]}
    <section id="comments"><article><p>{long}</p><p>{long} {long}</p></article></section><footer><p>{long}</p></footer></body>"""
    found = extract.labelled(page)
    assert [t for t, keep, _ in found if keep] == ARTICLE
    alone = {t for t, keep, cost in found if (cost >= 0) != keep}
    assert {long, "Short.", "No stop"} <= alone  # what the classifier gets wrong by itself


def test_form_around_the_page():
    page = f"<form><article><p>{ARTICLE[1]}</p></article></form><form><p>{ARTICLE[3]}</p></form>"
    assert extract.main_text(page) == ARTICLE[1]


def test_page_tables(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, "u", "", "old"), (None, "u", "<p>x", "t")], "page_id bigint, url string, html string, text string")
    got = extract.extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4
    q = extract.main_text_query(df).where("page_id = 2").collect()
    assert [(r.text, r.n_chars) for r in q] == [("", 0), ("", 0)] and extract.main_text_query(df.limit(0)).count() == 0


# ---- chat


def test_template_round_trip():
    rng = random.Random(6)
    words = ["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant\n", "\n", "x"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "a\nb", "<|x", "\\n", ""]), "".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 4))]
        f, spans = chat.format_turns(turns)
        assert chat.read_back(f) == turns
        assert "".join(chat.unescape(f[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize(
    "record",
    [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"data": {"prompt": "q", "response": "a"}},
    ],
)
def test_layouts_become_the_same_turns(record):
    assert chat.canonical_turns(record) == [("user", "q"), ("assistant", "a")]


def test_unknown_layouts_are_named():
    with pytest.raises(ValueError, match="strange"):
        chat.canonical_turns({"strange": 1})
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"])


def test_schema_and_record_paths_agree(spark):
    df = spark.createDataFrame([([{"role": "user", "content": "x"}],)], "messages array<struct<role:string,content:string>>")
    assert chat.layout_of(chat.schema_paths(df.schema)).name == "messages"


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "<|im_end|>"), (1, 0, "user", None), (2, None, None, ""), (None, 0, "assistant", "z"), (3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    q = {r.conv_id: r for r in chat.digest_query(df).collect()}
    assert set(q) == {1, 2, 3, None, -1}
    assert q[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\n<|im_end|>\n").hexdigest() and q[1].loss_chars == 10
    assert q[3].n_turns == 3 and q[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert q[-1].loss_sha256 == hashlib.sha256(chat.HOSTILE.encode()).hexdigest()
    assert chat.digest_query(df.limit(0)).count() == 1
    made = chat.format_json(spark.createDataFrame([(1, '{"prompt": "q", "completion": "a"}'), (2, None)], "id int, j string"), "id", "j").collect()
    assert chat.read_back(made[0].formatted) == [("user", "q"), ("assistant", "a")] and made[1].formatted == ""


def test_odd_records_do_not_stop_a_job(spark):
    good = '{"messages": [{"role": "user", "content": "q"}]'
    records = [good + "}", '{"messages": []}', good + ', "extra": null}', good + ', "extra": 5}', "{broken", "[" * 100_000, "3", '{"prompt": "q", "response": "a", "system": null}', '{"prompt": null, "response": null}']
    rows = chat.format_json(spark.createDataFrame(list(enumerate(records)), "id int, j string"), "id", "j").orderBy("conv_id").collect()
    turns = [None if r.formatted is None else chat.read_back(r.formatted) for r in rows]
    assert turns[:3] == [[("user", "q")], [], [("user", "q")]] and turns[7:] == [[("user", "q"), ("assistant", "a")], [("user", ""), ("assistant", "")]]
    assert turns[3:7] == [None] * 4 and all((r.error is None) == (r.formatted is not None) for r in rows) and "extra" in rows[3].error


def test_a_table_selects_its_layout_by_its_schema(spark):
    wanted = [("user", "q"), ("assistant", "a")]
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    tables = [
        (spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), None),
        (spark.createDataFrame(rows, "conversation_id bigint, message_index int, role string, content string"), None),
        (spark.createDataFrame([(1, "q", "a")], "id int, prompt string, response string"), "id"),
        (spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id int, conversations array<struct<from:string,value:string>>"), "id"),
        (spark.createDataFrame([(1, ("q", "a"))], "id int, data struct<prompt:string,response:string>"), "id"),
    ]
    for table, key in tables:
        assert [chat.read_back(r.formatted) for r in chat.format_table(table, key).collect()] == [wanted]
    with pytest.raises(chat.UnknownLayout, match="strange"):
        chat.format_table(spark.createDataFrame([(1, 2)], "id int, strange int"), "id")


def test_pages_of_the_test_tables(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    import os

    if not os.path.exists(path):
        pytest.skip("no test tables here")
    for r in spark.read.parquet(path).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert extract.main_text(r.html) == "\n".join(b for b in blocks if b)


