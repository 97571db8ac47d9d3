"""Line deduplication by winnowing over line hashes.

A text is a run of lines; long lines are cut after full stops as well (in the query after '!' and '?' too). Every line
is hashed. The gram of a line is the least run from it on with a third of `min_chars` characters, and a window the least
run with the other two thirds, or MOST lines where that takes more. The least gram hash of each window (the first of equal ones) is a fingerprint. Any run of
`min_chars` holds a whole window of grams, so copies of it have a fingerprint in common, whatever stands around them.

Fingerprints that stand twice are joined, and each is extended both ways to all least runs of `min_chars` characters
around it: those that cannot be shortened at their start, and those that cannot be shortened at their end. These are joined
in turn, so an extension may meet any earlier text and not only the earliest one with the fingerprint. A run that stood
before, in an earlier text or further up in its own, is deleted, overlapping ones together. As longer runs are made up of
least ones, just the lines go that lie in a run of `min_chars` that stood before; the earliest copy of every line
stays, in the order of ids, then of rows.

Lines count as equal when equal up to white space at their ends; their characters are counted with one of white space each.
Null text stays null; empty texts and tables pass through; texts are read whole, and a line may be of any length.
Rows with equal or null ids are separate texts. Other columns, whatever their names, pass through untouched.
Only DataFrame operations run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.exact import located
from palimpsest.llm.shared import discard, fresh, materialise

MIN_CHARS, MOST = 60, 4
#: What ends a sentence before a space, for the query.
SENTENCE_ENDS = ".!?"
_CUT = "\x01"


def units(text: Column, ends: str = ".") -> Column:
    """The lines of text, cut after each of ends before a space as well, each with what ends it, so that they join to the text again."""
    marked = F.coalesce(text, F.lit(""))
    for end in ("\n", *(e + " " for e in ends)):
        marked = F.replace(marked, F.lit(end), F.lit(end + _CUT))
    plain = F.split(marked, _CUT)
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(_CUT)), F.split(F.coalesce(text, F.lit("")), rf"(?<=\n)|(?<=[{ends}] )")).otherwise(plain)


def _least(chars: int, at: str, way: int = 1) -> str:
    """Lines of the least run of that many characters from line `at` (counted from 0) on (way 1) or up to it (-1); null where the text
    ends before. A line has one character at least."""
    # a few lines nearly always will do, and are added up much quicker than a list is folded: four at a time, on what the last four gave
    get = lambda j: f"get(lens, {at}{f' {way * j:+d}' if j else ''})"
    rest = f"slice(lens, {at} + 1, {chars})" if way > 0 else f"reverse(slice(lens, greatest(1, {at} - {chars - 2}), least({at} + 1, {chars})))"
    found = f"aggregate({rest}, struct(0 as k, 0 as s), (a, x) -> if(a.s >= {chars}, a, struct(a.k + 1 as k, a.s + x as s)), a -> if(a.s >= {chars}, a.k, null))"
    for base in (8, 4, 0):
        sums = [" + ".join([*(["s"] if base else []), *map(get, range(base, k))]) for k in range(base + 1, base + 5)]
        more = f"when {sums[3]} < {chars} then transform(array({sums[3]}), s -> {found})[0]"
        quick = [f"when {x} >= {chars} then {k}" for k, x in enumerate(sums, base + 1)]
        found = f"case {' '.join([quick[0], more, *quick[1:]])} end"
    return found


def line_table(docs: DataFrame, doc: Column, text_col: str, ends: str, min_chars: int) -> DataFrame:
    """Per text its key, line hashes and lengths, and the fingerprints (hash, line from 1 on)."""
    gram = max(1, min_chars // 3)
    cut = docs.select(doc.alias("doc"), units(F.col(f"`{text_col}`"), ends).alias("u"))
    # what follows the last line's end is no line
    cut = cut.select("doc", F.expr("if(element_at(u, -1) = '', slice(u, 1, size(u) - 1), u)").alias("u"))
    cut = cut.select("doc", F.transform("u", lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))).alias("u"))
    table = cut.select("doc", F.transform("u", lambda x: F.xxhash64(x)).alias("hs"), F.transform("u", lambda x: F.length(x) + 1).alias("lens"))
    # a run of one line has that line's hash
    short = f"transform(array({_least(gram, 'j')}), k -> if(k is null, null, xxhash64(slice(hs, j + 1, k))))[0]"
    table = table.withColumn("gs", F.expr(f"array_compact(transform(lens, (x, j) -> if(x >= {gram}, hs[j], {short})))"))
    # windows hold lines with a gram only; a text without a whole window is shorter than min_chars
    chars = max(1, min_chars - gram)
    sums = ["lens[j]", *(" + ".join(["lens[j]", *(f"get(lens, j + {i})" for i in range(1, k))]) for k in range(2, MOST))]
    at = lambda i: f"gs[j + {i}]" if i else "g"
    picked = []
    for k in range(1, MOST + 1):  # the place of the least of k grams, the first of equal ones
        place = f"j + {k}"
        for i in reversed(range(k - 1)):
            rest = at(k - 1) if i == k - 2 else f"least({', '.join(at(x) for x in range(i + 1, k))})"
            place = f"if({at(i)} <= {rest}, j + {i + 1}, {place})"
        picked.append(place if k == 1 else f"if(j + {k} <= size(gs), {place}, null)")
    cases = " ".join(f"when {x} >= {chars} then {p}" for x, p in zip(sums, picked))
    picks = f"array_except(transform(gs, (g, j) -> case {cases} else {picked[-1]} end), array(cast(null as int)))"
    table = table.withColumn("at", F.expr(picks))
    return table.select("doc", "hs", "lens", F.expr("transform(at, i -> struct(gs[i - 1] as h, i as i))").alias("prints"))


def met_again(rows: DataFrame, key: str, place: Column, tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows (written) whose key stands twice, with `later`, whether another stands before; and a table to discard after use."""
    first = rows.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    # written first: a join of two tables lets a hot key be split, one above an aggregation doesn't
    first = materialise(first.select(key, "first"), tag, short=True)
    return rows.join(first, key).withColumn("later", place != F.col("first")).drop("first"), first


def extended(table: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc, start, n) of the least runs of min_chars around the fingerprints that stand twice, written. Of a text that holds a run
    several times only the first is listed; what the others cover is merged to stretches with a null key."""
    prints = table.select("doc", F.explode("prints").alias("p")).select("doc", "p.*")
    hits, shared = met_again(prints, "h", F.struct("doc", "i"), "lines-shared")
    met = table.select("doc", "hs", "lens").join(hits.groupBy("doc").agg(F.sort_array(F.collect_list("i")).alias("hits")), "doc")
    # lines of the least run from each line on, and up to each
    met = met.withColumn("ns", F.expr(f"transform(lens, (x, j) -> {_least(min_chars, 'j')})")).withColumn("ne", F.expr(f"transform(lens, (x, j) -> {_least(min_chars, 'j', -1)})"))
    # a run that cannot be shorter at its end is listed at its first fingerprint i, so it begins after the one before and no later than i;
    # one that can't be shorter at its start at its last, so it ends before the next. One number a run: start and lines
    one = min_chars + 1
    alone = "ns[i - 1] = 1 and coalesce(get(ne, i - 2) = 1, i = 1) and coalesce(get(ns, i) = 1, i = size(lens))"  # long lines on both sides
    begin = f"transform(sequence(greatest(coalesce(get(hits, t - 1), 0), i - coalesce(get(ne, i - 2), i)) + 1, i), p -> if(p + ns[p - 1] > i, {one}L * p + ns[p - 1], null))"
    stop = "least(coalesce(get(hits, t + 1), size(lens) + 1), i + coalesce(get(ns, i), size(lens) - i + 1)) - 1"
    end = f"transform(sequence(i, {stop}), q -> if(q - ne[q - 1] < i and ns[q - ne[q - 1]] <> ne[q - 1], {one}L * (q - ne[q - 1] + 1) + ne[q - 1], null))"
    met = met.withColumn("runs", F.expr(f"array_compact(flatten(transform(hits, (i, t) -> if({alone}, array({one}L * i + 1), concat({begin}, {end})))))"))
    key = "if(r.n = 1, hs[r.start - 1], xxhash64(slice(hs, r.start, r.n)))"
    met = met.withColumn("runs", F.expr(f"sort_array(transform(transform(runs, r -> struct(int(r div {one}) as start, int(r % {one}) as n)), r -> struct({key} as key, r.start as start, r.n as n)))"))
    met = met.withColumn("first", F.expr("filter(runs, (r, j) -> j = 0 or runs[j - 1].key <> r.key)"))
    again = "sort_array(transform(filter(runs, (r, j) -> j > 0 and runs[j - 1].key = r.key), r -> struct(r.start as start, r.start + r.n as stop)))"
    kind = "array<struct<key:bigint,start:int,n:int>>"
    merged = f"""aggregate({again}, struct(0 as start, 0 as stop, cast(array() as {kind}) as done), (a, x) ->
        if(x.start <= a.stop, struct(a.start as start, greatest(a.stop, x.stop) as stop, a.done as done),
           struct(x.start as start, x.stop as stop, if(a.stop = 0, a.done, concat(a.done, array(struct(cast(null as bigint) as key, a.start as start, a.stop - a.start as n)))) as done)),
        a -> if(a.stop = 0, a.done, concat(a.done, array(struct(cast(null as bigint) as key, a.start as start, a.stop - a.start as n)))))"""
    met = met.withColumn("again", F.when(F.size("first") < F.size("runs"), F.expr(merged)))
    rows = met.select("doc", F.explode(F.expr("if(again is null, first, concat(first, again))")).alias("r"))
    found = materialise(rows.select("r.key", "doc", "r.start", "r.n"), "lines-runs")
    discard(shared)
    return found


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, stats: bool = False, ends: str = ".") -> DataFrame:
    """docs with later repeated runs deleted from text_col; with stats also __runs and __removed_chars. Long lines are cut after ends."""
    src, file, row = located(docs)
    doc = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(file)).alias("f"), F.col(row).alias("r"))
    table = materialise(line_table(src, doc, text_col, ends, min_chars), "lines-table")
    found = extended(table, min_chars)
    met, first = met_again(found.where("key is not null"), "key", F.struct("doc", "start"), "lines-first")
    later = met.where("later").select("doc", "start", "n").unionByName(found.where("key is null").select("doc", "start", "n"))
    later = later.select("doc", "start", (F.col("start") + F.col("n") - 1).alias("stop"))
    gone = later.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    kept = F.expr(
        """aggregate(gone, named_struct('at', 1, 'runs', 0, 'kept', cast(array() as array<struct<start:int,n:int>>)), (a, x) -> named_struct(
            'at', greatest(a.at, x.stop + 1),
            'runs', a.runs + if(a.runs = 0 or x.start > a.at, 1, 0),
            'kept', if(x.start > a.at, concat(a.kept, array(named_struct('start', a.at, 'n', x.start - a.at))), a.kept)))"""
    )
    key, held, cut, text = (fresh(src, n) for n in ("__line_doc", "__line_kept", "__line_units", "__line_text"))
    gone = materialise(gone.select(F.col("doc").alias(key), kept.alias(held)), "lines-gone")
    discard(table, found, first)
    # always by shuffle: what is deleted grows with the corpus, so a broadcast would only serve small ones
    whole = F.col(f"`{text_col}`")
    joined = src.join(gone.hint("merge"), doc == F.col(key), "left").withColumn(cut, F.when(F.col(held).isNotNull(), units(whole, ends)))
    rest = F.expr(f"concat_ws('', flatten(transform(concat({held}.kept, array(named_struct('start', {held}.at, 'n', greatest(size({cut}) - {held}.at + 1, 0)))), x -> slice({cut}, x.start, x.n))))")
    out = joined.withColumn(text, F.when(F.col(held).isNull(), whole).otherwise(rest))
    cols = [F.col(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if stats:
        cols += [F.coalesce(f"{held}.runs", F.lit(0)).cast("bigint").alias("__runs"), (F.length(F.coalesce(whole, F.lit(""))) - F.length(F.coalesce(text, F.lit("")))).cast("bigint").alias("__removed_chars")]
    return out.select(*cols)


def lines_query(docs: DataFrame) -> DataFrame:
    """Per document: its text without later repeated runs, and what was deleted."""
    found = deduplicate_lines(docs.select("doc_id", "text"), stats=True, ends=SENTENCE_ENDS)
    return found.withColumnsRenamed({"__runs": "n_runs", "__removed_chars": "removed_chars"})
