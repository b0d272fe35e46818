"""Operator 3, HTML extraction by union-free wrappers inferred from the pages of a host.

A page is a stream of tags and texts. A wrapper is a stream of tags, constant texts, slots, optional groups and
repeated groups: a regular expression without unions. It begins as a host's first page and is aligned with one page
after another. Where the streams agree nothing changes; texts that differ become a slot; blocks of one tag that follow
each other become a repeated group, whose body is the alignment of its instances; what only one side has becomes an
optional group, which is divided when a page has a part of it. What slots take from a page is its data; constants
are the template.

Inference is a fold that can be cut: each task folds the pages that it reads into a partial wrapper for every host, and
partial wrappers are aligned with one another by the same routine after one shuffle of wrappers. Pages are joined
with their host's wrapper for extraction; a host with many pages is a skewed key of that join and no more.
"""

from __future__ import annotations

import html
import hashlib
import json
import re
import sys
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, small_batches, written

sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # groups nest as tags do, to DEEPEST
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HOSTS_AT_ONCE, DEEPEST, PASSES = 5000, 100, 24
_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|[^<]+|<", re.S | re.I)
_marks = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# a node: [kind, value, option, weight, body]; kinds: o(pen) c(lose) v(oid) t(ext) s(lot) r(epeated)
KIND, VALUE, OPTION, WEIGHT, BODY = range(5)


_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_WITHIN = {
    "p": frozenset("html body div article section main aside header footer nav form td th li dd blockquote figure fieldset table button details".split()),
    "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select", "optgroup")),
    "tr": frozenset(("table", "tbody", "thead", "tfoot")), "td": frozenset(("tr",)), "th": frozenset(("tr",)),
}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}


def nodes_of(page: str) -> list[list]:
    """The tags and texts of a page, each open tag with its close tag. Scripts, styles, comments and white space between
    tags are nothing; a close tag without its open tag is dropped, and close tags that a page leaves out are put in. As
    in browsers, tags do not nest without end: beyond ``DEEPEST`` one is a tag without a close tag, and a tag that the
    page doesn't finish takes the rest of it."""
    out: list[list] = []
    stack: list[str] = []

    def close(k: int) -> None:
        for name in reversed(stack[k:]):
            out.append(["c", name, 0, 0, None])
        del stack[k:]

    def end_open(names: tuple[str, ...], within: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                close(k)
                return
            if stack[k] in within:
                return

    for m in _token.finditer(page):
        name = m.group(2)
        if name:
            name = name.lower()
            raw = m.group(0)
            if raw[1] == "/":
                if name in stack:
                    close(len(stack) - 1 - stack[::-1].index(name))
                continue
            if name in _P_ENDS:
                end_open(("p",), _WITHIN["p"])
            if name in _ENDS:
                end_open(_ENDS[name], _WITHIN[name])
            marks = "".join(f" {k.lower()}={v.strip('\"').strip(chr(39))}" for k, v in _marks.findall(m.group(3))) if m.group(3) else ""
            if name in VOID or raw.endswith("/>") or len(stack) >= DEEPEST:
                out.append(["v", name + marks, 0, 0, None])
            else:
                out.append(["o", name + marks, 0, 0, None])
                stack.append(name)
        elif m.group(1) is None and not m.group(0).startswith(("<!", "<?")):
            text = " ".join(html.unescape(m.group(0)).split())
            if text:
                if out and out[-1][KIND] == "t":
                    text = out.pop()[VALUE] + " " + text
                out.append(["t", text, 0, len(text), None])
    close(0)
    return out


def block_end(nodes: list[list], i: int) -> int:
    """The place after the close tag of the block that opens at i; -1 if it has none."""
    name, depth = nodes[i][VALUE].split(" ")[0], 0
    for j in range(i, len(nodes)):
        n = nodes[j]
        if n[KIND] == "o" and n[VALUE].split(" ")[0] == name:
            depth += 1
        elif n[KIND] == "c" and n[VALUE] == name:
            depth -= 1
            if not depth:
                return j + 1
    return -1


def repeated_tags(nodes: list[list]) -> set[str]:
    """Tags of blocks that follow one another, at any depth, and of repeated groups."""
    found, closed, stack = set(), {}, []
    for i, n in enumerate(nodes):
        if n[KIND] == "o":
            if closed.get(i) == n[VALUE]:
                found.add(n[VALUE])
            stack.append(n[VALUE])
        elif n[KIND] == "c":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].split(" ")[0] == n[VALUE]:
                    closed[i + 1] = stack[k]
                    del stack[k:]
                    break
        elif n[KIND] == "r":
            found.add(n[VALUE])
    return found


def fold(nodes: list[list], tags: set[str]) -> list[list]:
    """Runs of blocks of each tag as repeated groups; a group keeps its blocks as instances."""
    out, i = [], 0
    while i < len(nodes):
        n = nodes[i]
        if n[KIND] == "o" and n[VALUE] in tags and (end := block_end(nodes, i)) > 0:
            block = nodes[i:end]
            if out and out[-1][KIND] == "r" and out[-1][VALUE] == n[VALUE] and out[-1][OPTION] == n[OPTION]:
                out[-1][BODY].append(block)
            else:
                out.append(["r", n[VALUE], n[OPTION], 0, [block]])
            i = end
        elif n[KIND] == "r" and out and out[-1][KIND] == "r" and out[-1][VALUE] == n[VALUE] and out[-1][OPTION] == n[OPTION]:
            out[-1][BODY].extend(n[BODY])
            i += 1
        else:
            out.append([n[KIND], n[VALUE], n[OPTION], n[WEIGHT], list(n[BODY])] if n[KIND] == "r" else n)
            i += 1
    return out


def matching(x: list[str], y: list[str]) -> list[tuple[int, int, int]]:
    """(place in x, place in y, how many) of equal runs, in order and without crossing.

    Equal ends are taken off first. Between them anchors are the occurrences, the k-th of either side, of signs that are
    as many on both sides, or of all signs where there are none such; of these the longest ordered chain stays, and the
    gaps of the chain are divided in turn. A pass over the gaps takes n log n; after ``PASSES`` of them what is left is
    unlike, so two large pages that have little in common cost as much as two that are alike.
    """
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(x), 0, len(y))]
    for _ in range(PASSES):
        again = []
        for i, j, p, q in gaps:
            while i < j and p < q and x[i] == y[p]:
                pairs.append((i, p))
                i, p = i + 1, p + 1
            while i < j and p < q and x[j - 1] == y[q - 1]:
                j, q = j - 1, q - 1
                pairs.append((j, q))
            if i == j or p == q:
                continue
            many, other = Counter(x[i:j]), Counter(y[p:q])
            as_many = {s for s, n in many.items() if other.get(s) == n}
            places: dict[str, list[int]] = defaultdict(list)
            for k in range(p, q):
                if not as_many or y[k] in as_many:
                    places[y[k]].append(k)
            seen: Counter[str] = Counter()
            found = []
            for k in range(i, j):
                s = x[k]
                if s in places and seen[s] < len(places[s]):
                    found.append((k, places[s][seen[s]]))
                    seen[s] += 1
            chain = _chain(found)
            if not chain:
                continue
            pairs += chain
            bounds = [(i - 1, p - 1), *chain, (j, q)]
            again += [(a + 1, b, c + 1, d) for (a, c), (b, d) in zip(bounds, bounds[1:]) if b > a + 1 and d > c + 1]
        gaps = again
        if not gaps:
            break
    out: list[tuple[int, int, int]] = []
    for i, p in sorted(pairs):
        if out and i == out[-1][0] + out[-1][2] and p == out[-1][1] + out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, p, 1))
    return out


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain that rises on both sides, of pairs that rise on the first."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, p) in enumerate(pairs):
        n = bisect_left(ends, p)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(p)
            at.append(k)
        else:
            ends[n], at[n] = p, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _signs(nodes: list[list]) -> list[str]:
    return ["t" if n[KIND] in "ts" else n[KIND] + n[VALUE] for n in nodes]


def _plain(nodes: list[list]) -> list[list]:
    """Copies without options of their own: they are an instance's body."""
    return [[n[KIND], n[VALUE], 0, n[WEIGHT], n[BODY]] for n in nodes]


def body_of(group: list) -> list[list]:
    """The wrapper of a repeated group's instances."""
    body = None
    for block in group[BODY]:
        block = [list(n) for n in block]
        inside = block[1:-1]
        body = inside if body is None else align(body, inside)
    head = group[BODY][0]
    group[BODY] = [[head[0][:2] + [0, 0, None], *(body or []), head[-1][:2] + [0, 0, None]]]
    return group[BODY][0]


def _merge(a: list, b: list) -> list:
    option = a[OPTION] or b[OPTION]
    if a[KIND] in "ts":
        same = a[KIND] == b[KIND] == "t" and a[VALUE] == b[VALUE]
        return ["t" if same else "s", a[VALUE] if same else "", option, a[WEIGHT] + b[WEIGHT], None]
    if a[KIND] == "r":
        return ["r", a[VALUE], option, 0, a[BODY] + b[BODY]]
    return [a[KIND], a[VALUE], option, 0, None]


def align(a: list[list], b: list[list]) -> list[list]:
    """The least wrapper of this kind for what ``a`` and ``b`` are wrappers of."""
    tags = repeated_tags(a) | repeated_tags(b)
    a, b = fold(a, tags), fold(b, tags)
    top = max([0, *(n[OPTION] for n in a)])
    b = [n[:OPTION] + [n[OPTION] and n[OPTION] + top, n[WEIGHT], n[BODY]] for n in b]
    top = max([top, *(n[OPTION] for n in b)])
    x, y = _signs(a), _signs(b)
    out: list[tuple[list, int]] = []  # (node, 1 in a only, 2 in b only, 3 in both)
    i = p = 0
    for j, q, n in [*matching(x, y), (len(x), len(y), 0)]:
        out += [(m, 1) for m in a[i:j]] + [(m, 2) for m in b[p:q]] + [(_merge(a[j + k], b[q + k]), 3) for k in range(n)]
        i, p = j + n, q + n
    made, last = [], (None, None)
    for n, side in out:
        if side != 3 or n[OPTION]:  # one group for each run of the same old group and side
            if (side, n[OPTION]) != last:
                top += 1
            last = (side, n[OPTION])
            n = [n[KIND], n[VALUE], top, n[WEIGHT], n[BODY]]
        else:
            last = (None, None)
        if n[KIND] == "r" and len(n[BODY]) > 1:
            body_of(n)
        made.append(n)
    return made


def tidy(nodes: list[list]) -> list[list]:
    """Groups numbered from 1 in the order of their places, and every repeated group with one body."""
    number: dict[int, int] = {}
    out = []
    for n in fold(nodes, repeated_tags(nodes)):
        if n[KIND] == "r":
            body = body_of(n)
            n[BODY] = [[body[0], *tidy(body[1:-1]), body[-1]]]
        out.append([n[KIND], n[VALUE], number.setdefault(n[OPTION], len(number) + 1) if n[OPTION] else 0, n[WEIGHT], n[BODY]])
    return out


def extract(wrapper: list[list], page: list[list], path: tuple[str, ...] = (), every: bool = False) -> list[tuple[str, str]]:
    """(path, text) of each slot of ``wrapper`` in a page, in the page's order; texts that it doesn't foresee count as slots."""
    tags = repeated_tags(wrapper) | repeated_tags(page)
    a, b = fold(wrapper, tags), fold(page, tags)
    x, y = _signs(a), _signs(b)
    pair: dict[int, int] = {}
    for i, j, n in matching(x, y):
        pair |= {j + k: i + k for k in range(n)}
    out, stack = [], list(path)
    for j, n in enumerate(b):
        m = a[pair[j]] if j in pair else None
        if n[KIND] == "t":
            if every or m is None or m[KIND] == "s" or m[VALUE] != n[VALUE]:
                out.append(("/".join(stack), n[VALUE]))
        elif n[KIND] == "o":
            stack.append(n[VALUE].split(" ")[0])
        elif n[KIND] == "c":
            if n[VALUE] in stack[len(path) :]:
                while stack.pop() != n[VALUE]:
                    pass
        elif n[KIND] == "r":
            name = n[VALUE].split(" ")[0]
            body = m[BODY] if m else [[]]
            inner = body[0][1:-1] if len(body) == 1 else body_of(["r", n[VALUE], 0, 0, body])[1:-1]
            for block in n[BODY]:
                out += extract(inner, block[1:-1], (*stack, name), every)
    return out


def regions(wrapper: list[list], path: tuple[str, ...] = ()) -> dict[str, int]:
    """Characters that slots took during inference, by the first three tags above them."""
    out: dict[str, int] = {}
    stack = list(path)
    for n in wrapper:
        if n[KIND] == "s":
            key = "/".join(stack[:3])
            out[key] = out.get(key, 0) + n[WEIGHT]
        elif n[KIND] == "o":
            stack.append(n[VALUE].split(" ")[0])
        elif n[KIND] == "c" and n[VALUE] in stack[len(path) :]:
            while stack.pop() != n[VALUE]:
                pass
        elif n[KIND] == "r":
            for block in n[BODY]:
                for k, v in regions(block[1:-1], (*stack, n[VALUE].split(" ")[0])).items():
                    out[k] = out.get(k, 0) + v
    return out


def host_of(url: Column) -> Column:
    """The host in lower case without its port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def give() -> pa.RecordBatch:
        rows = [(h, n, json.dumps(tidy(w)), key) for h, (n, w, key) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.binary())], ["host", "pages", "wrapper", "key"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
            nodes, key = nodes_of(page.as_py()), hashlib.md5(page.as_buffer()).digest()
            if host not in held:
                if len(held) >= HOSTS_AT_ONCE:
                    yield give()
                held[host] = [1, tidy(nodes), key]  # the key of all pages while they are copies of one
            else:
                of = held[host]
                of[0] += 1
                of[1] = align(of[1], nodes)
                of[2] = key if of[2] == key else None
    if held:
        yield give()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial wrappers sorted by host: one for each host."""
    host, pages, wrapper, key = None, 0, None, None

    def row() -> pa.RecordBatch:
        done = tidy(wrapper)
        areas = regions(done)
        main = max(sorted(areas), key=areas.get) if areas else None
        return pa.RecordBatch.from_arrays([pa.array([host]), pa.array([pages], pa.int64()), pa.array([json.dumps(done)]), pa.array([main], pa.string()), pa.array([key is not None])], ["host", "pages", "wrapper", "main", "alike"])

    for batch in batches:
        for h, n, w, k in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "wrapper", "key"))):
            if h == host:
                pages, wrapper, key = pages + n, align(wrapper, json.loads(w)), key if key == k else None
            else:
                if host is not None:
                    yield row()
                host, pages, wrapper, key = h, n, json.loads(w), k
    if host is not None:
        yield row()


def infer_wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, pages, wrapper, main, alike) for each host: number of pages, the wrapper as JSON, the part of the page with
    most data, and whether all pages are copies of one.

    Null and empty pages have no part in it; rows without a url or a host in it are the host ""; a repeated row counts as
    a page and changes nothing else; of parts with equally much data the first by name is the main one; pages are read
    whole; an empty table gives an empty one; other columns are never read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("html")).where("html <> ''")
    partial = rows.mapInArrow(lean(_partial), "host string, pages long, wrapper string, key binary")
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(lean(_whole), "host string, pages long, wrapper string, main string, alike boolean")


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, host, text, fields): the data of every page by its host's wrapper.

    ``fields`` has (path, value) of each slot in the page's order; ``text`` is those of the host's main part, a line
    each. On a host with one page, however many copies, or without a slot there is nothing to compare, so every text is data. A null or empty page has a null
    text and no fields; pages without a host are one host; null ids and repeated rows are kept; an empty table gives an
    empty one; malformed markup is text or is skipped, never an error. Pages are read whole, however long
    or deep. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    wrappers = written(infer_wrappers(pages, url, page), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts, fields = [], []
            for host, raw, alike, w, main in zip(batch.column("host").to_pylist(), batch.column("html"), *(batch.column(c).to_pylist() for c in ("alike", "wrapper", "main"))):
                if w is None:
                    texts.append(None)
                    fields.append([])
                    continue
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = json.loads(w)
                lone = alike or main is None
                found = extract(known[host], nodes_of(raw.as_py()), every=lone)
                if lone:
                    sizes: dict[str, int] = {}
                    for p, v in found:
                        key = "/".join(p.split("/")[:3])
                        sizes[key] = sizes.get(key, 0) + len(v)
                    main = max(sorted(sizes), key=sizes.get) if sizes else None
                texts.append("\n".join(v for p, v in found if main is not None and (p == main or p.startswith(main + "/"))))
                fields.append([{"path": p, "value": v} for p, v in found])
            kind_of = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), pa.array(texts, pa.string()), pa.array(fields, kind_of)], ["id", "host", "text", "fields"])

    rows = pages.select(F.col(page_id).alias("id"), host_of(F.col(url)).alias("host"), F.when(F.col(page) != "", F.col(page)).alias("html"))
    joined = rows.join(wrappers, "host", "left").withColumn("wrapper", F.when(F.col("html").isNotNull(), F.col("wrapper")))
    out = joined.mapInArrow(lean(run), f"id {kind}, host string, text string, fields array<struct<path string, value string>>")
    return out.withColumnRenamed("id", page_id)
