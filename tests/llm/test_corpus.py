"""Operators over whole tables: classifier, exact, line and near deduplication, packing, pipeline."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import exact, lines, near, packing, pii, quality

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "same text"), (5, "same text"), (6, "same\ntext "), (None, "no id"), (None, "no id")]


def edges(spark):
    rows = [(i, t, "c", 7, 1.5, "k") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, digest string, n bigint, score double, __text string")


# ---- classifier


def junk_and_prose(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 150))]
        kind = rng.randrange(4)
        if kind == 0:
            yield 0, " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            yield 0, " ".join([words[0]] * rng.randint(30, 80))
        else:
            yield 1, " ".join(words) + "."


def test_network_learns_and_covers_long_texts():
    sample = [(y, t.encode()) for y, t in junk_and_prose(300, 1)]
    net = quality.fit(sample, epochs=12)
    test = list(junk_and_prose(300, 2))
    scores = net.scores([t for _, t in test])
    assert np.mean((scores >= 0.5) == np.array([y for y, _ in test])) > 0.95
    assert len(quality.chunks_of(b"x" * 100_000)) == -(-(100_000 - quality.CHUNK) // quality.STEP) + 1
    again = net.scores([t for _, t in test], block=3)
    assert np.allclose(scores, again, atol=1e-5)
    tail = " ".join(t for y, t in test if y)[:6000]
    assert abs(net.scores([tail])[0] - net.scores([tail + "THE!! ONE!! " * 400])[0]) > 0.01


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = quality.Net.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [rng.integers(1, 255, (n, quality.CHUNK)).astype(np.uint8) for n in (1, 3)]
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        out = []
        for d, t, k in zip(docs, y, w):
            h = net.features(net.pooled(d))
            z = np.concatenate([h.max(0), h.mean(0)]) @ net.p["out"] + net.p["out_b"][0]
            out.append(k * (np.log1p(np.exp(z)) - t * z))
        return sum(out) / 2

    g = quality._gradients(net, docs, y, w)
    for name in ("out", "out_b", "hid", "hid_b", "conv", "conv_b", "emb"):
        flat, got = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        some = np.argsort(-np.abs(got))[:6] if name == "emb" else rng.integers(0, flat.size, 6)  # bytes that no filter picks have no gradient
        for i in some:
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * step) - got[i]) < 2e-3, name


def slow_score(net, text):
    """The network by plain loops over chunks, positions and filters."""
    data = (text or "").encode()
    n = max(1, -(-max(0, len(data) - quality.CHUNK) // quality.STEP) + 1)
    features = []
    for c in range(n):
        chunk = data[c * quality.STEP : c * quality.STEP + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        echoes = [any(q - lag - 7 >= 0 and chunk[q - 7 : q + 1] == chunk[q - 7 - lag : q + 1 - lag] for lag in range(2, quality.ECHO + 1)) and chunk[q] != 0 for q in range(quality.CHUNK)]
        rows = [np.append(net.p["emb"][b], float(e)) for b, e in zip(chunk, echoes)]
        tops = [max(np.concatenate(rows[at : at + quality.WIDTH]) @ net.p["conv"][:, f] for at in range(quality.CHUNK - quality.WIDTH + 1)) + net.p["conv_b"][f] for f in range(quality.FILTERS)]
        features.append(np.maximum(np.maximum(tops, 0) @ net.p["hid"] + net.p["hid_b"], 0))
    z = np.concatenate([np.max(features, 0), np.mean(features, 0)]) @ net.p["out"] + net.p["out_b"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_loops():
    net = quality.Net.fresh(5)
    texts = [None, "", "short é", "ab " * 200, "One two three four. " * 60, "x" * quality.CHUNK, "y" * (quality.CHUNK + 1)]
    assert np.allclose(net.scores(texts), [slow_score(net, t) for t in texts], atol=1e-4)


def test_training_reads_whole_texts_one_an_id(spark):
    """What sets the labels apart stands at the end of long texts; rows that share an id, or have both labels, don't multiply."""
    rng = random.Random(3)
    same = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(900))
    docs = [(i, same() + (" ZZZ### ZZZ### ZZZ###" if i % 2 else " fine words here ok")) for i in range(160)]
    df = spark.createDataFrame(docs + docs[:1] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(0, 1)], "doc_id bigint, quality int")
    net = quality.train(df, labels)
    fresh_texts = [same() + " ZZZ### ZZZ### ZZZ###", same() + " fine words here ok"]
    scores = net.scores(fresh_texts)
    assert scores[0] > 0.5 > scores[1]


def test_one_kind_of_label(spark):
    docs = edges(spark)
    labels = spark.createDataFrame([(4, 1)], "doc_id bigint, quality int")
    got = quality.scores_query(docs, labels).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {1.0}
    assert {r.score for r in quality.scores_query(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(EDGES)
    assert quality.scores_query(docs.limit(0), labels).count() == 0


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.scores_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


# ---- exact


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return {k: (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}


@pytest.fixture(params=["10m", "-1"])
def broadcast_up_to(request, spark):
    """Every join as Spark plans it, and all of them shuffled."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, broadcast_up_to, weak):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "b", " ", "\n"]) for _ in range(rng.randint(0, 6)))) for i in range(200)] + EDGES
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kw = {"digest_of": lambda sha: sha.substr(1, 1)} if weak else {}  # sixteen keys: nearly every hit is a collision
    got = exact.groups(df, **kw).collect()
    want = brute_groups(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)


def test_small_batches_give_the_same(spark, tmp_path):
    rows = [(i, f"t{i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    many = {(r.id, r.keep_id, r.group_size, r.kept) for r in exact.groups(df, bytes_per_batch=1).collect()}
    assert many == {(i, i % 7, 9 if i % 7 < 4 else 8, i < 7) for i, _ in rows}


def test_exact_tables(spark):
    df = edges(spark)
    out = exact.deduplicate(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "no id"), (3, " \n\t "), (4, "word " * 30000), (6, "same\ntext ")]
    assert exact.deduplicate(df.limit(0)).count() == 0 and exact.groups_query(df.limit(0)).count() == 0


# ---- lines


def cut(t):
    return re.split(r"(?<=\n)|(?<=[.] )", t)


def test_lines_random(spark):
    rng = random.Random(1)
    pool = [f"line number {i} has words" + " pad" * rng.choice([0, 0, 15]) + rng.choice(["\n", ". ", "? "]) for i in range(14)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    got = {r.doc_id: r for r in lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), stats=True).collect()}
    strip = lambda u: u.strip(" \t\n\x0b\f\r")
    first, earlier = {}, set()
    for i, t in docs:
        for u in cut(t):
            first.setdefault(strip(u), i)
    assert {strip(u) for _, t in docs for u in cut(t)} - {""} <= {strip(u) for r in got.values() for u in cut(r.text)} | {""}
    for i, t in docs:
        units, kept = [strip(u) for u in cut(t) if u], [strip(u) for u in cut(got[i].text) if u]
        # guarantee: what stays holds no long line that an earlier text has
        assert not [u for u in kept if len(u) >= lines.MIN_CHARS and first[u] < i]
        # and no untouched text holds a run of three lines that an earlier text has
        runs = {tuple(units[k : k + 3]) for k in range(len(units) - 2)}
        if got[i].text == t:
            assert not [r for r in runs & earlier if sum(map(len, r)) >= lines.MIN_CHARS]
        else:
            assert len(got[i].text) < len(t) and got[i]["__removed_chars"] == len(t) - len(got[i].text)
        earlier |= runs


def test_lines_leave_unique_texts_alone(spark):
    shared = "This passage is repeated word for word in several documents of the table, more than once.\n"
    docs = [(1, "Own start one.\n" + shared + "Own end one.\n"), (2, "Own start two.\n" + shared + "Own end two.\n"), (3, "Nothing here is shared with anyone at all, as it seems to me.\n"), (4, "A.\nA.\nA.\n" * 300)]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got[1] == docs[0][1] and got[2] == "Own start two.\nOwn end two.\n" and got[3] == docs[2][1] and got[4].startswith("A.\n") and len(got[4]) < 100


def test_runs_of_three_short_lines_go(spark):
    rng = random.Random(2)
    docs = []
    for i in range(40):
        run = "".join(f"shared {i} {k} {rng.random()}\n" for k in range(3))
        docs += [(2 * i, f"Start {2 * i}.\n{run}End {2 * i}.\n"), (2 * i + 1, f"Start {2 * i + 1}.\n{run}End {2 * i + 1}.\n")]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {i: f"Start {i}.\nEnd {i}.\n" if i % 2 else t for i, t in docs}


def plain_runs(docs, least=lines.MIN_CHARS):
    """Exactly the lines go that lie in a run of `least` characters which stood before."""
    seen, out = set(), {}
    for i, t in docs:
        units, gone = [u for u in cut(t) if u], set()
        for k in range(len(units)):
            for n in range(1, len(units) - k + 1):
                run = tuple(u.strip() for u in units[k : k + n])
                if sum(len(u) + 1 for u in run) >= least:
                    gone |= set(range(k, k + n)) if run in seen else set()
                    seen.add(run)
                    break  # longer runs are made up of least ones from their first lines on ...
        for k in range(len(units)):
            for n in range(1, k + 2):
                run = tuple(u.strip() for u in units[k - n + 1 : k + 1])
                if sum(len(u) + 1 for u in run) >= least:
                    gone |= set(range(k - n + 1, k + 1)) if ("up", run) in seen else set()
                    seen.add(("up", run))
                    break  # ... and up to their last ones
        out[i] = "".join(u for k, u in enumerate(units) if k not in gone)
    return out


def slow_winnowing(docs, least=lines.MIN_CHARS):
    """The operator step by step: hashes, grams, window minima, joined fingerprints, runs around them."""
    import xxhash

    def chained(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), h)
        return h

    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    gram = least // 3

    def run(lens, at, chars, way=1):
        total = n = 0
        while total < chars and 0 <= at + way * n < len(lens):
            total += lens[at + way * n]
            n += 1
        return n if total >= chars else None

    table, prints = {}, collections.defaultdict(list)
    for i, t in docs:
        units = [u for u in cut(t) if u]
        hs, lens = [chained([u.strip().encode()]) for u in units], [len(u.strip()) + 1 for u in units]
        ks = [k for k in (run(lens, a, gram) for a in range(len(lens))) if k]
        gs = [signed(hs[a] if k == 1 else chained(hs[a : a + k])) for a, k in enumerate(ks)]
        picked = set()
        for a in range(len(gs)):
            w = min(run(lens, a, least - gram) or lines.MOST, lines.MOST)
            if a + w <= len(gs):
                picked.add(a + gs[a : a + w].index(min(gs[a : a + w])))
        table[i] = (units, hs, lens)
        for a in sorted(picked):
            prints[gs[a]].append((i, a))
    keys = collections.defaultdict(set)
    for i, a in (x for some in prints.values() if len(some) > 1 for x in some):
        units, hs, lens = table[i]
        spans = [(p, p + n) for p in range(a + 1) if (n := run(lens, p, least)) and p + n > a]
        spans += [(q - n + 1, q + 1) for q in range(a, len(lens)) if (n := run(lens, q, least, -1)) and q - n + 1 <= a]
        for p, q in spans:
            keys[chained(hs[p:q])].add((i, p, q))
    gone = collections.defaultdict(set)
    for some in keys.values():
        first = min(some)[:2]
        for i, p, q in some:
            if (i, p) != first:
                gone[i] |= set(range(p, q))
    return {i: "".join(u for a, u in enumerate(table[i][0]) if a not in gone[i]) for i, _ in docs}


def line_corpus(seed):
    """Short and long lines, blank ones, repeats inside a text, and families whose later texts share more than the first has."""
    rng = random.Random(seed)
    docs = []
    for i in range(25):
        a, b, c, d, x = (f"{w} of family {i} {rng.random():.6f}\n" for w in "abcdx")
        docs += [a + b + c + x, f"Start {i}.\n{a}{b}{c}{d}Middle {i}.\n", f"Begin {i}.\n{a}{b}{c}{d}Close {i}.\n"]
    for words in ([0, 1, 4, 6, 15], [0, 0, 0, 1], [0, 2, 30]):
        pool = ["\n", "a\n"] + [f"{'pad ' * rng.choice(words)}{i}" + rng.choice(["\n", ". ", " \n"]) for i in range(12)]
        docs += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    return list(enumerate(docs + ["A.\n" * 500, "", "x" * 5000, "A.\n" * 500]))


@pytest.mark.parametrize("seed", [5, 6])
def test_lines_equal_the_slow_versions(spark, broadcast_up_to, seed):
    docs = line_corpus(seed)
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == slow_winnowing(docs)
    assert got == plain_runs(docs)


def test_fingerprints_are_window_minima(spark):
    """Few lines are fingerprints where lines are short."""
    rng = random.Random(4)
    docs = [(i, "".join(f"{rng.randrange(10**6)}\n" for _ in range(200))) for i in range(20)]
    table = lines.line_table(spark.createDataFrame(docs, "doc_id bigint, text string"), lines.F.col("doc_id"), "text", ".", 60)
    found = sum(len(r.prints) for r in table.collect())
    assert 20 * 200 / 7 < found < 20 * 200 / 2


def test_min_chars_is_honoured(spark):
    short = "".join(f"{w}\n" for w in "one two three four five six".split())  # 28 characters
    docs = [(i, f"Own start {i}.\n{short}Own end {i}.\n") for i in range(3)]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == dict(docs)
    cut_off = lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_chars=28).collect()
    assert {r.doc_id: r.text for r in cut_off} == {0: docs[0][1], 1: "Own start 1.\nOwn end 1.\n", 2: "Own start 2.\nOwn end 2.\n"}


def test_query_cuts_after_every_sentence_end(spark):
    for end in ("! ", "? "):
        said = "this sentence is said again and again in one text after another" + end
        docs = [(1, "Own start one" + end + said + "Own end one."), (2, "Own start two" + end + said + "Own end two.")]
        got = {r.doc_id: r.text for r in lines.lines_query(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got == {1: docs[0][1], 2: "Own start two" + end + "Own end two."}


def test_line_tables(spark):
    df = edges(spark)
    out = lines.deduplicate_lines(df)
    assert out.columns == df.columns and out.count() == len(EDGES)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and lines.lines_query(df.limit(0)).count() == 0


# ---- near


def brute_components(rows, k, percent=80):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:  # else too unlike in size
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (small + large - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, n):
    """Families of near copies with edits of several rates, some of them chains, and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for family in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            if rng.random() < 0.3 and out:
                base = out[-1].split()
            rate = rng.choice([0, 0.005, 0.02, 0.05])
            out.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in base))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("short", [2, 16])
def test_components_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(near, "SHORT", short)
    monkeypatch.setattr(near, "BLOCK_DOCS", 8)
    rows = copies(short, 30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.components_query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows, 4)


def test_string_ids(spark, monkeypatch):
    monkeypatch.setattr(near, "SHORT", 2)
    rows = [(f"d{i:03d}", t) for i, t in copies(5, 8)]
    got = {r.id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), words=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4).items()}


def test_hashes_follow_the_words():
    a = near.shingle_set("One two\tthree\nFOUR five", 4)
    assert len(a) == 2 and np.array_equal(a, near.shingle_set(" one TWO three four five ", 4))
    assert len(near.shingle_set("ä Ä", 1)) == 2  # only A-Z are lower-cased
    assert len(near.shingle_set("a b", 4)) == 1 and not len(near.shingle_set(" \n", 4)) and not len(near.shingle_set(None, 4))
    assert not np.array_equal(near.shingle_set("a b", 4), near.shingle_set("a b a b", 4))
    rng = random.Random(0)
    some = {" ".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(500)}
    assert len({int(near.shingle_set(s, 4)[0]) for s in some}) == len(some)


def test_overlap_bound():
    for k in (32, 64):
        m = near.least_overlap(k, 0.8)
        draws = np.random.default_rng(0).binomial(k, 0.8, 200_000)
        assert m > 1 and (draws >= m).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 3)]
    got = {r.node: r.part for r in near.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_near_tables(spark):
    df = edges(spark)
    out = near.deduplicate(df)
    assert out.columns == df.columns
    q = near.near_duplicates(df, words=4).collect()
    assert len(q) == len(EDGES) and all(r.component_id is None and r.kept for r in q if r.id is None)
    assert {r.id: (r.n_shingles, r.component_id) for r in q if r.id} == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 6: (1, 5)}
    assert near.components_query(df.limit(0)).count() == 0


# ---- packing


def test_packing_rebuilds_every_document(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["tok", "word", "é", "<|endoftext|>", "\n"]) for _ in range(rng.choice([0, 3, 50, 3000])))) for i in range(40)] + [(40, None), (41, "")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    pieces = packing.pack(df, length=256)
    rows = pieces.collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_vocabulary()[0])
    docs = collections.defaultdict(list)
    for r in rows:
        docs[r.id].append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.offset + r.length <= 256
    for i, t in texts:
        parts = sorted(docs[i], key=lambda r: r.start)
        ids = [int(x) for r in parts for x in np.frombuffer(r.ids, "<u4")]
        assert ids == [*tk.encode(t or "", add_special_tokens=False).ids, 1] and parts[0].doc_tokens == len(ids)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    fill = collections.defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for seq, spans in fill.items():
        spans.sort()
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert seq == max(fill) or sum(n for _, n in spans) == 256
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(pieces).collect()}
    assert whole == {s: sum(n for _, n in x) for s, x in fill.items()}


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "é", "1"])
def test_any_text_is_tokenised(unit):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.default_vocabulary()[0])
    bpe = packing.ByteBpe(*packing.default_vocabulary())
    for n in (1000, 1_200_000):
        assert bpe.ids(unit * n + " end").tolist() == tk.encode(unit * n + " end", add_special_tokens=False).ids


def test_packing_tables(spark):
    q = packing.digest_query(edges(spark)).collect()
    assert sum(r.doc_id == 1 and r.doc_tokens == 1 for r in q) == 1 and packing.digest_query(edges(spark).limit(0)).count() == 0


# ---- pipeline


@needs_tables
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        from palimpsest.llm.shared import materialise

        kept = materialise(stage(spark, kept, SF), "test-stage")
        assert kept.columns == names
        after = {r.doc_id: r.text for r in kept.collect()}
        counts.append(len(after))
        assert set(after) <= set(before)
        if name == "exact dedup":
            best = brute_groups(list(before.items()))
            assert set(after) == {i for i, _ in best.values()}
        if name == "near dedup":
            assert set(after) == {i for i, (_, c) in brute_components(sorted(before.items()), 5).items() if c == i}
        if name == "personal data":
            assert after == {i: pii.redact_text(t) for i, t in before.items()}
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    out = cp.run(spark, SF)
    assert out.select("doc_id").distinct().count() == counts[4]
