"""Operator 1, suffix-array dedup by prefix-free parsing.

A passage is ``MIN_WORDS`` words or more that stand alike in two places. It is found from the corpus order of all
suffixes, which is never sorted as a whole:

1. A rolling hash of four words is a trigger where it is the least of some six in a row; triggers cut a text into
   phrases. Every 50-word window holds phrases that its own words alone decide; the least hash among them names the
   window, so equal windows have equal names wherever they stand.
2. Names that occur once are dropped (one shuffle of hashes). For the others, the words of the windows so named go, as
   32-bit prints, to the name's partition (one join with the text, one shuffle of contexts).
3. There the contexts are a small, highly repetitive text. A trigger that depends on its own four words alone parses it
   into phrases; distinct phrases are the dictionary. The suffix array of the dictionary and that of the parse, by
   prefix doubling, combine into the corpus order: a suffix is ranked by the rest of its phrase, then by the rank of
   the parse after it. Neighbours in that order that agree in 50 words are passages.

The parse for naming takes the least of six instead of a fixed residue, as only that puts phrases into every window.
Equal contexts are one before the sort, so that thousands of copies cost as many rows and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _W, _WINV, lean, mix, powers, small_batches, window_hashes, word_hashes
from tidemark.llm.substring_dedup import MIN_WORDS, inside, shared_places, spans_of, split_words

TRIGGER, AMONG, RESIDUE = 4, 6, 8
BATCH_WORDS = 400_000


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of h[start:end] for each pair."""
    n = len(h)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(h, powers(n, _W), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * powers(n + 1, _WINV)[start] + (end - start).astype(np.uint64))


def least_of(r: np.ndarray, size: int = AMONG) -> np.ndarray:
    """Positions that hold the (last) least value of some ``size`` neighbours."""
    n = len(r) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = r[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size):
        lower = r[k : k + n] <= best
        np.copyto(best, r[k : k + n], where=lower)
        at[lower] = k
    mark = np.zeros(len(r), bool)
    mark[at + np.arange(n)] = True
    return np.flatnonzero(mark)


def names(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, their rows, their positions, the word at which each one's naming phrase starts, its hash)."""
    row, pos = inside(first, MIN_WORDS)
    win = np.flatnonzero(pos >= 0)
    if not len(win):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    tau = least_of(window_hashes(h, TRIGGER))
    ph = range_hashes(h, tau[:-1], tau[1:] + TRIGGER)
    before = np.zeros(len(h) + 1, np.int64)
    before[tau + 1] = 1
    before = np.cumsum(before)  # triggers before each position
    lo = before[win + AMONG - 1]
    hi = before[win + MIN_WORDS - TRIGGER - AMONG + 2] - 1  # phrases lo..hi-1 have both triggers among those decided inside
    level = [np.arange(len(ph))]
    while (1 << len(level)) <= int((hi - lo).max()):
        a, half = level[-1], 1 << (len(level) - 1)
        left, right = a[: len(a) - half], a[half:]
        level.append(np.where(ph[right] < ph[left], right, left))
    size = hi - lo
    depth = np.frexp(size.astype(np.float64))[1] - 1
    chosen = np.empty(len(win), np.int64)
    for k, a in enumerate(level):
        at = np.flatnonzero(depth == k)
        left, right = a[lo[at]], a[hi[at] - (1 << k)]
        chosen[at] = np.where(ph[right] < ph[left], right, left)
    return win, row[win], pos[win], tau[chosen], ph[chosen]


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("k").to_numpy()
        for lo, _, part, _, start, end, first in split_words(batch):
            _, row, _, at, h = names(word_hashes(part, start, end), first)
            new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
            row, at, h = row[new], at[new], h[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(key[lo + row]), pa.array((at - first[row]).astype(np.int32))], ["h", "k", "pos"]
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by text: each row's text as a whole and, of one row of each text, the words of windows with shared names."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, key, at = batch.column("id").to_numpy(), batch.column("k").to_numpy(), batch.column("at")
        new = np.concatenate([[before is None or key[0] != before], key[1:] != key[:-1]])
        before = key[-1]
        for lo, hi, part, _, start, end, first in split_words(batch):
            some, total = at.slice(lo, hi - lo), np.diff(first)
            owner = np.repeat(np.arange(hi - lo), np.diff(some.offsets.to_numpy()))
            wanted = np.zeros(int(first[-1]) + 1, bool)
            p = some.flatten().to_numpy() + first[owner]
            wanted[p[new[lo + owner]]] = True
            h = word_hashes(part, start, end)
            win, row, pos, name, nh = names(h, first)
            take = wanted[name]
            win, row, pos, name, nh = win[take], row[take], pos[take], name[take], nh[take]
            head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (win[1:] != win[:-1] + 1)])[: len(name)])
            count = np.diff(np.concatenate([head, [len(name)]]))
            size = count + MIN_WORDS - 1
            ends = np.concatenate([[0], np.cumsum(size)])
            idx = np.repeat(win[head] - ends[:-1], size) + np.arange(ends[-1])
            prints = (h[idx] >> np.uint64(32)).astype("<u4")
            long = np.flatnonzero(total >= MIN_WORDS)
            bounds = np.concatenate([ends * 4, np.full(len(long), ends[-1] * 4)]).astype(np.int32)
            context = pa.BinaryArray.from_buffers(pa.binary(), len(head) + len(long), [None, pa.py_buffer(bounds), pa.py_buffer(prints)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([nh[head], mix(key[lo + long].view(np.uint64))]).view(np.int64)),
                    pa.array(np.concatenate([ids[lo + row[head]], ids[lo + long]])),
                    pa.array(np.concatenate([pos[head], np.zeros(len(long), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([count + MIN_WORDS - 1, total[long]]).astype(np.int32)),
                    context,
                ],
                ["h", "id", "pos", "n", "words"],
            )


def suffix_ranks(symbols: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Dense ranks, in lexicographic order, of the suffixes of many strings; ``rest`` is each suffix's length. Equal suffixes share a rank."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step, most = 1, int(rest.max(initial=0))
    while step < most:
        after = np.zeros(len(rank), np.int64)
        more = np.flatnonzero(rest > step)
        after[more] = rank[more + step]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def corpus_order(text: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``wanted`` positions in the lexicographic order of the suffixes that start there, each up to its context's end.

    ``text``: symbols of all contexts; ``first``: each context's first position, and the text's length. The order comes
    from the suffix ranks of the dictionary and of the parse. Every wanted suffix has more than TRIGGER symbols.
    """
    n = len(text)
    context = np.repeat(np.arange(len(first) - 1), np.diff(first))
    wide = text.astype(np.uint64)
    roll = window_hashes(wide, TRIGGER)
    cut = np.zeros(n, bool)
    cut[: len(roll)] = roll % np.uint64(RESIDUE) == 0
    cut &= np.arange(n) + TRIGGER <= first[context + 1]
    cut[first[:-1][np.diff(first) > 0]] = True
    begin = np.flatnonzero(cut)
    of = context[begin]
    follows = np.concatenate([of[1:] == of[:-1], [False]])
    stop = np.where(follows, np.concatenate([begin[1:], [n]]) + TRIGGER, first[of + 1])
    _, sample, phrase = np.unique(range_hashes(mix(wide + np.uint64(1)), begin, stop), return_index=True, return_inverse=True)
    size = (stop - begin)[sample]
    at = np.concatenate([[0], np.cumsum(size)])  # the dictionary, one phrase after another
    inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
    suffix = suffix_ranks(text[np.repeat(begin[sample], size) + inner], np.repeat(size, size) - inner)
    parse = suffix[at[:-1]][phrase]
    left = np.searchsorted(of, of, "right") - np.arange(len(of))
    order = suffix_ranks(parse, left)
    j = np.searchsorted(begin, wanted, "right") - 1
    alpha = suffix[at[phrase[j]] + wanted - begin[j]]
    after = np.where(follows[j], order[np.minimum(j + 1, len(order) - 1)], 0)
    return wanted[np.argsort(alpha * (len(order) + 2) + after, kind="stable")]


def _context_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(prints of all words, bounds of each context)."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    return np.frombuffer(column.buffers()[2] or b"", "<u4")[bounds[0] : bounds[-1]], bounds - bounds[0]


def _judge(table: pa.Table, twice: np.ndarray) -> pa.RecordBatch:
    """Passages among the unlike contexts of whole names, sorted by name, words, id and position; ``twice``: has it copies?"""
    table = table.combine_chunks()
    ids, pos, n = (table[c].to_numpy() for c in ("id", "pos", "n"))
    text, bounds = _context_words(table["words"].combine_chunks())
    size = np.diff(bounds)
    alone = np.flatnonzero(twice & (size == 0))  # the first of equal texts
    out = [(ids[alone], pos[alone], n[alone], np.ones(len(alone), bool))]
    rep = np.flatnonzero(size > 0)
    if len(rep):
        first = np.concatenate([[0], np.cumsum(size[rep])])
        t = text[np.repeat(bounds[:-1][rep] - first[:-1], size[rep]) + np.arange(first[-1])]
        starts = size[rep] - MIN_WORDS + 1
        base = np.concatenate([[0], np.cumsum(starts)])
        wanted = np.repeat(first[:-1] - base[:-1], starts) + np.arange(base[-1])
        order = corpus_order(t, first, wanted)
        window = window_hashes(mix(t.astype(np.uint64) + np.uint64(1)), MIN_WORDS)[order]
        equal = np.concatenate([[False], window[1:] == window[:-1]])
        klass = np.cumsum(~equal) - 1
        c = np.searchsorted(first, order, "right") - 1
        place = np.empty(len(rep), np.int64)
        place[np.lexsort((pos[rep], ids[rep]))] = np.arange(len(rep))
        where = place[c] * (1 << 32) + (order - first[c])
        least = np.minimum.reduceat(where, np.flatnonzero(~equal))
        hit = (np.bincount(klass)[klass] > 1) | twice[rep][c]
        keep = where == least[klass]
        i = np.lexsort((order[hit],))
        s, k, c = order[hit][i], keep[hit][i], c[hit][i]
        if len(s):
            head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])]))
            count = np.diff(np.concatenate([head, [len(s)]]))
            cc = rep[c[head]]
            out.append((ids[cc], pos[cc] + s[head] - first[c[head]], count + MIN_WORDS - 1, k[head]))
    return _found(*(np.concatenate(x) for x in zip(*out)))


def _found(who: np.ndarray, pos: np.ndarray, n: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(keep.astype(bool))], ["id", "pos", "n", "keep"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For contexts sorted by name, words, id and position. One that equals the one before it is a passage as a whole and
    goes on at once, so of equal contexts only the first is held, however many there are."""
    held: list[pa.RecordBatch] = []
    twice: list[np.ndarray] = []
    total, last = 0, None
    for big in batches:
        for i in range(0, big.num_rows, 500):
            batch = big.slice(i, 500)
            text, bounds = _context_words(batch.column("words"))
            wh = range_hashes(text.astype(np.uint64) + np.uint64(1), bounds[:-1], bounds[1:])
            rows = np.stack([batch.column("h").to_numpy(), np.diff(bounds), wh.view(np.int64), batch.column("id").to_numpy(), batch.column("pos").to_numpy().astype(np.int64)])
            before = np.concatenate([rows[:, :1] + 1 if last is None else last, rows[:, :-1]], axis=1)
            last = rows[:, -1:]
            same = (rows[:3] == before[:3]).all(axis=0)
            copy = same & (rows[3:] != before[3:]).any(axis=0)
            group = np.cumsum(~same) - 1
            more = np.bincount(group[copy] + 1, minlength=int(group[-1]) + 2) > 0
            if more[0]:
                twice[-1][-1] = True
            if copy.any():
                yield _found(rows[3][copy], rows[4][copy], batch.column("n").to_numpy()[copy], np.zeros(int(copy.sum()), bool))
            if same.all():
                continue
            held.append(batch.filter(pa.array(~same)))
            twice.append(more[1:].copy())
            total += int(np.diff(bounds)[~same].sum())
            if total < BATCH_WORDS:
                continue
            table, flags = pa.Table.from_batches(held), np.concatenate(twice)
            h = table["h"].to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield _judge(table.slice(0, cut), flags[:cut])
                table, flags = table.slice(cut).combine_chunks(), flags[cut:]
            held, twice = table.to_batches(), [flags]
            total = sum(int(b.column("words").nbytes) // 4 for b in held) if len(change) else 0
    if held:
        yield _judge(pa.Table.from_batches(held), np.concatenate(twice))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, keep) of every maximal span of words made of passages that stand in two places.

    Words are runs without ASCII white space, and single characters of scripts without spaces, counted from 0; end_word
    is exclusive. ``keep`` marks the spans of first
    occurrences (least id, then position); a span that isn't kept may overlap one that is. A text that is equal to
    another as a whole is reported as one span; of equal texts only the first is searched further.
    Rows with a null id or text, or of fewer than 50 words, have no spans. Rows that repeat id and text are one
    document. Texts of any length are read whole. An empty table gives an empty one. Other columns are never read, whatever
    their names. ``doc_id`` must be an integer.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("k"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    named = rows.select("k", "t").mapInArrow(lean(_names), "h long, k long, pos int")
    shared = named.repartition("h").sortWithinPartitions("h", "k", "pos").mapInArrow(lean(shared_places, 10_000), "k long, pos int")
    around = shared.groupBy("k").agg(F.collect_set("pos").alias("at"))
    contexts = (
        rows.join(around, "k", "left").select("k", "id", "t", F.coalesce("at", F.array().cast("array<int>")).alias("at"))
        .sortWithinPartitions("k", "id").mapInArrow(lean(_contexts), "h long, id long, pos int, n int, words binary")
    )
    found = contexts.repartition("h").sortWithinPartitions("h", "words", "id", "pos").mapInArrow(lean(_passages), "id long, pos int, n int, keep boolean")
    spans = found.repartition("id").sortWithinPartitions("id", "keep", "pos").mapInArrow(lean(spans_of, 10_000), "id long, start_word int, end_word int, keep boolean")
    return spans.withColumnRenamed("id", doc_id)
