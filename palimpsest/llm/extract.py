"""Main-text extraction by minimum cut.

A page becomes a list of text blocks, each with its chain of open elements. One linear classifier looks at each block by
itself (tag, length, links, sentence end) and another at each container (article, navigation, advert ..., by tag, class,
id and role); their log-odds are the capacities of the nodes' edges to the source or the sink. Smoothness edges join
neighbours in page order, the more the closer they stand in the DOM; blocks below one parent, through a node for it; and each
block and its nearest container. The blocks on the source side of a minimum cut are the main text: a short line inside
the article stays and a long sentence inside an advert goes, though their own costs say otherwise.

Null or empty html gives the empty text. Blocks are whole, white space inside them is one space, and they are joined by line
feeds in page order; references are decoded and nothing is capped. Broken markup is read as browsers do, in one
pass: a quote inside an unquoted value is part of it, what follows a tag that never ends is lost. Rows,
repeated ones too, keep their other columns; one called like the new one, in whatever case, is replaced. An empty table gives
no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import append_columns

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute, or what closes the tag; at the page's end neither.
_ATTR = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements whose inside is no text of the page; of the first ones markup inside doesn't count.
_RAW = frozenset("script style title textarea iframe noscript noembed noframes".split())
_SKIPPED = _RAW | frozenset("template svg object select".split())
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _SKIPPED}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_SHUT = {"tr": 2, "td": 1, "th": 1, "tbody": 3}

#: Words of tags, classes, ids and roles that the container classifier knows.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset search head".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe subscription signup sidebar aside menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended widget popup modal overlay "
    "login search pagination pager copyright contentinfo complementary hidden skip tags toc".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article post entry story content main articlebody".split())

#: Log-odds in thousandths: of a block, and of a container for each block that it holds.
BLOCK_WEIGHTS = {"bias": -300, "paragraph": 500, "title": 900, "heading": 200, "linked": -1500, "doubling": 400, "short": -1200, "sentence": 200, "copyright": -1500}
CONTAINER_WEIGHTS = {"furniture": -2600, "article": 2000, "article_word": 1200, "page": 1000}
#: Capacities of smoothness edges: neighbours that are siblings, blocks of one parent, a block and its container.
ADJACENT, SAME_PARENT, INSIDE = 600, 300, {"furniture": 3000, "article": 3000, "article_word": 3000, "page": 1000}


@dataclass(frozen=True)
class Element:
    tag: str
    words: frozenset[str]
    hidden: bool
    number: int


@dataclass(frozen=True)
class Block:
    path: tuple[Element, ...]
    text: str
    linked: float


# ---- blocks -----------------------------------------------------------------------------------------


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", characters, {}), ("start", tag, attributes) and ("end", tag, {}) of a page, in one pass."""
    at, n, start = 0, len(page), 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1 : at + 2]
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            if after not in ("!", "?", "/"):
                at += 1  # a lone "<" is text
                continue
            if at > start:
                yield "text", page[start:at], {}
            comment = page.startswith("<!--", at) and not page.startswith(("<!-->", "<!--->"), at)
            end = page.find("-->", at + 4) if comment else page.find(">", at)
            at = start = n if end < 0 else end + (3 if comment else 1)
            continue
        if at > start:
            yield "text", page[start:at], {}
        tag, at, attributes, done = name[0].lower(), name.end(), {}, False
        while at < n and not done:
            m = _ATTR.match(page, at)
            if m is None or m.end() == at:
                at += 1
                continue
            at, done = m.end(), m[1] is not None
            if not done:
                attributes.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
                if m[3] is m[4] is m[5] is None and page[at - 1] == "=" and page[at : at + 1] in ("'", '"'):
                    at = n  # a quote that never ends
        start = at
        if not done:
            break
        if closing:
            yield "end", tag, {}
            continue
        yield "start", tag, attributes
        if tag in _SKIPPED:
            end = _END_OF[tag].search(page, at)
            at = start = end.start() if end else n
    if start < n:
        yield "text", page[start:], {}


def _element(tag: str, attributes: dict[str, str], number: int) -> Element:
    words = {w.lower() for a in ("class", "id", "role") if a in attributes for w in _WORD.findall(html.unescape(attributes[a]))}
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN_STYLE.search(attributes.get("style", "")))
    return Element(tag, frozenset(words), hidden, number)


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty text blocks in order."""
    found: list[Block] = []
    stack: list[Element] = []
    buffer: list[tuple[str, bool]] = []
    link, number = False, 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join([s for s, _ in buffer])).split())
            if text:
                linked = sum(len(s) for s, k in buffer if k)
                found.append(Block(tuple(stack), text, linked / max(1, sum(len(s) for s, _ in buffer))))
            buffer.clear()

    for kind, value, attributes in tokens(page):
        if kind == "text":
            buffer.append((value, link))
        elif value not in BLOCK:
            if value == "a":
                link = kind == "start"
            elif value in ("br", "img", "wbr", "input"):
                buffer.append((" ", False))
        else:
            flush()
            link = False
            if kind == "end":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == value:
                        del stack[k:]
                        break
                continue
            if stack and stack[-1].tag == "p":
                stack.pop()
            shut = _CLOSES.get(value, ())
            for _ in range(_SHUT.get(value, 1)):
                if stack and stack[-1].tag in shut:
                    stack.pop()
            if value != "hr":
                number += 1
                stack.append(_element(value, attributes, number))
    flush()
    return found


# ---- classifiers and edges --------------------------------------------------------------------------


def block_cost(b: Block) -> int:
    """Log-odds (thousandths) that a block is main text, by itself; positive speaks for content."""
    w, tag, n = BLOCK_WEIGHTS, b.path[-1].tag if b.path else "", len(b.text)
    total = w["bias"] + int(w["linked"] * b.linked) + w["doubling"] * max(0, min(4, n.bit_length() - 6))
    if tag in ("p", "pre", "blockquote"):
        total += w["paragraph"]
    elif tag == "h1":
        total += w["title"]
    elif tag in ("h2", "h3", "h4", "h5", "h6"):
        total += w["heading"]
    if n < 32:
        total += w["short"]
    if b.text[-1] in ".!?…。":
        total += w["sentence"]
    return total + (w["copyright"] if "©" in b.text else 0)


def container_of(path: tuple[Element, ...], wrappers: frozenset[int]) -> tuple[int, str]:
    """Number and kind of the element that says what a block is part of. Whatever stands inside furniture is furniture; else the
    innermost article counts, and else the page. A form around an article (wrappers) is none."""
    found = 0, "page"
    inside = False  # an article
    for e in path:
        if e.tag in ("html", "body"):
            continue
        furniture = (e.tag in FURNITURE_TAGS and e.number not in wrappers) or e.hidden or (e.tag == "header" and not inside)
        if furniture or e.words & FURNITURE_WORDS:
            return e.number, "furniture"
        if e.tag in ARTICLE_TAGS:
            found, inside = (e.number, "article"), True
        elif e.words & ARTICLE_WORDS and not inside:
            found = e.number, "article_word"
    return found


def graph(blocks: list[Block]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Costs of the nodes (blocks, then containers, then parents) and the symmetric capacities between them."""
    costs = [block_cost(b) for b in blocks]
    edges: dict[tuple[int, int], int] = {}
    for i in range(1, len(blocks)):
        a, b = blocks[i - 1].path, blocks[i].path
        same = 0
        while same < min(len(a), len(b)) and a[same].number == b[same].number:
            same += 1
        edges[i - 1, i] = 2 * ADJACENT // max(2, len(a) + len(b) - 2 * same)
    wrappers = frozenset(e.number for b in blocks for k, e in enumerate(b.path) if e.tag == "form" and any(x.tag in ARTICLE_TAGS for x in b.path[k:]))
    inside = [container_of(b.path, wrappers) for b in blocks]
    held = Counter(inside)
    place = {c: len(blocks) + k for k, c in enumerate(held)}
    costs += [CONTAINER_WEIGHTS[kind] * n for (_, kind), n in held.items()]
    edges.update(((i, place[c]), INSIDE[c[1]]) for i, c in enumerate(inside))
    parents = Counter(b.path[-2].number for b in blocks if len(b.path) > 1)
    place = {e: len(costs) + k for k, e in enumerate(e for e, n in parents.items() if n > 1)}
    costs += [0] * len(place)
    edges.update(((i, place[b.path[-2].number]), SAME_PARENT) for i, b in enumerate(blocks) if len(b.path) > 1 and b.path[-2].number in place)
    return costs, edges


# ---- minimum cut ------------------------------------------------------------------------------------


def min_cut(costs: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (the largest such side, so ties are content).

    Nodes whose own cost outweighs all their edges are settled first, which is exact; shortest augmenting paths do the rest.
    """
    n = len(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    costs, label = list(costs), [None] * n
    pending = deque(range(n))
    while pending:
        i = pending.popleft()
        if label[i] is not None:
            continue
        if abs(costs[i]) > sum(near[i].values()) or not near[i]:
            label[i] = costs[i] >= 0
            for j, c in near[i].items():
                costs[j] += c if label[i] else -c
                del near[j][i]
                pending.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, kept in zip(rest, _source_side(rest, costs, near)):
            label[i] = kept
    return label  # type: ignore[return-value]


def _source_side(nodes: list[int], costs: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Which of the nodes can't reach the sink once the flow is greatest; arcs are numbered in pairs, a and a ^ 1."""
    number = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    head: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(nodes) + 2)]

    def join(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((forth, back))

    for v in nodes:
        a = number[v]
        if costs[v] > 0:
            join(source, a, costs[v], 0)
        elif costs[v] < 0:
            join(a, sink, -costs[v], 0)
        for u, c in near[v].items():
            if number[u] > a:
                join(a, number[u], c, c)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque((source,))
        while queue and level[sink] < 0:
            a = queue.popleft()
            for k in out[a]:
                if room[k] > 0 and level[head[k]] < 0:
                    level[head[k]] = level[a] + 1
                    queue.append(head[k])
        if level[sink] < 0:
            break
        todo = [0] * len(out)  # the first arc of each node that may still lead on
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[k] for k in path)
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
                first = next(i for i, k in enumerate(path) if not room[k])
                a = head[path[first] ^ 1]
                del path[first:]
                continue
            arcs, i = out[a], todo[a]
            while i < len(arcs) and (room[arcs[i]] <= 0 or level[head[arcs[i]]] != level[a] + 1):
                i += 1
            todo[a] = i
            if i < len(arcs):
                path.append(arcs[i])
                a = head[arcs[i]]
            elif path:
                level[a] = -1
                a = head[path.pop() ^ 1]
            else:
                break
    reaches = [False] * len(out)
    reaches[sink] = True
    queue = deque((sink,))
    while queue:
        a = queue.popleft()
        for k in out[a]:
            if room[k ^ 1] > 0 and not reaches[head[k]]:
                reaches[head[k]] = True
                queue.append(head[k])
    return [not x for x in reaches[: len(nodes)]]


# ---- pages ------------------------------------------------------------------------------------------


def labelled(page: str | None) -> list[tuple[str, bool, int]]:
    """(text, content?, its own log-odds) of every block."""
    blocks = blocks_of(page) if page else []
    costs, edges = graph(blocks)
    return [(b.text, k, c) for b, k, c in zip(blocks, min_cut(costs, edges), costs)]


def main_text(page: str | None) -> str:
    return "\n".join([t for t, keep, _ in labelled(page) if keep])


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df without html_col and with the main text in out_col; a column already called out_col is replaced."""
    return append_columns(df, html_col, lambda pages: [pa.array([main_text(x) for x in pages], pa.string())], [(out_col, "string")], drop_source=True)


def main_text_query(pages: DataFrame) -> DataFrame:
    """The contract's columns per page."""
    return extract(pages.select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
