"""Operator 9, substring dedup by difference-cover anchors.

A passage is ``MIN_WORDS`` or more words that stand alike in two places. Windows of 20 words are hashed only where the
word's position modulo 31 is in a perfect difference set: for any two positions i and j there is a shift below 31 that
puts both on the cover, so the two places of a passage share an anchor at the same distance from its start. Anchors
whose hash stands alone are dropped. Around the others the match is extended: every run of ``MIN_WORDS`` words that
holds the anchor is hashed, and those found in two places are passages; their union gives maximal spans. Occurrences
are compared by sorted neighbours, never in pairs, so a passage in a million documents costs as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, mix, pieces, small_batches, text_bytes, window_hashes, word_hashes, words

MIN_WORDS, PERIOD, COVER = 50, 31, (1, 5, 11, 24, 25, 27)
WINDOW = MIN_WORDS - PERIOD + 1
_on = np.zeros(PERIOD, bool)
_on[list(COVER)] = True


def split_words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column("t"))
    for lo, hi in pieces(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        start, end, first = words(part, at, lone=True)
        yield lo, hi, part, at, start, end, first


def inside(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the windows of ``size`` words that lie in one row; position -1 where one doesn't."""
    n = max(0, int(first[-1]) - size + 1)
    row = np.searchsorted(first, np.arange(n), "right") - 1
    pos = np.arange(n) - first[row] if n else np.zeros(0, np.int64)
    return row, np.where(np.arange(n) + size <= first[row + 1], pos, -1)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column("k").to_numpy()
        for lo, _, part, _, start, end, first in split_words(batch):
            row, pos = inside(first, WINDOW)
            at = np.flatnonzero((pos >= 0) & _on[pos % PERIOD])
            at = at[np.diff(first)[row[at]] >= MIN_WORDS]
            h = window_hashes(word_hashes(part, start, end), WINDOW)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), pa.array(key[lo + row[at]]), pa.array(pos[at].astype(np.int32))], ["h", "k", "pos"]
            )


def adjacent(batches: Iterator[pa.RecordBatch], key: str, who: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For rows sorted by ``key`` and ``who``: (rows, is there another of the key beside it, is it the key's first)."""
    last, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        k, other = table.column(key).to_numpy(), np.zeros(table.num_rows - 1, bool)
        for c in who:
            x = table.column(c).to_numpy()
            other |= x[1:] != x[:-1]
        same = k[1:] == k[:-1]
        hit = np.zeros(table.num_rows, bool)
        hit[1:] |= same & other
        hit[:-1] |= same & other
        # a row that repeats the very place before it is no other place
        first = np.concatenate([[True], ~same])
        if before is not None:
            hit[0] |= before[0]
            first[0] = before[1]
        yield table.slice(0, table.num_rows - 1), hit[:-1], first[:-1]
        last, before = table.slice(table.num_rows - 1), (hit[-1], first[-1])
    if last is not None:
        yield last, np.array([before[0]]), np.array([before[1]])


def shared_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, hit, _ in adjacent(batches, "h", ("k", "pos")):
        yield rows.filter(pa.array(hit)).select(["k", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows sorted by text: each row's whole text as one place, and of one row of each text the runs around anchors."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, key, at = batch.column("id").to_numpy(), batch.column("k").to_numpy(), batch.column("at")
        new = np.concatenate([[before is None or key[0] != before], key[1:] != key[:-1]])
        before = key[-1]
        for lo, hi, part, _, start, end, first in split_words(batch):
            some, total = at.slice(lo, hi - lo), np.diff(first)
            row = np.repeat(np.arange(hi - lo), np.diff(some.offsets.to_numpy()))
            p = some.flatten().to_numpy()
            p, row = p[new[lo + row]], row[new[lo + row]]
            p = p + first[row]
            n = int(first[-1])
            mark = np.bincount(np.maximum(p - PERIOD + 1, first[row]), minlength=n + 1) - np.bincount(p + 1, minlength=n + 1)[: n + 1]
            wrow, pos = inside(first, MIN_WORDS)
            s = np.flatnonzero((np.cumsum(mark)[: len(pos)] > 0) & (pos >= 0))
            h = window_hashes(word_hashes(part, start, end), MIN_WORDS)[s]
            long = np.flatnonzero(total >= MIN_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([h, mix(key[lo + long].view(np.uint64))]).view(np.int64)),
                    pa.array(np.concatenate([ids[lo + wrow[s]], ids[lo + long]])),
                    pa.array(np.concatenate([pos[s], np.zeros(len(long), np.int64)]).astype(np.int32)),
                    pa.array(np.concatenate([np.full(len(s), MIN_WORDS), total[long]]).astype(np.int32)),
                ],
                ["h", "id", "pos", "n"],
            )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, hit, first in adjacent(batches, "h", ("id", "pos")):
        yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("pos"), rows.column("n"), pa.array(first)], ["id", "pos", "n", "keep"]).filter(pa.array(hit))


def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions of overlapping runs of rows that are sorted by id, keep and position."""
    open_ = None  # id, keep, start, end
    for batch in batches:
        if not batch.num_rows:
            continue
        who, keep = batch.column("id").to_numpy(), batch.column("keep").to_numpy(zero_copy_only=False)
        start = batch.column("pos").to_numpy().astype(np.int64)
        end = start + batch.column("n").to_numpy()
        if open_ is not None:
            who, keep = np.concatenate([[open_[0]], who]), np.concatenate([[open_[1]], keep])
            start, end = np.concatenate([[open_[2]], start]), np.concatenate([[open_[3]], end])
        owner = np.concatenate([[0], np.cumsum((who[1:] != who[:-1]) | (keep[1:] != keep[:-1]))])
        reach = np.maximum.accumulate(end + owner * (1 << 40)) - owner * (1 << 40)
        cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])])
        at = np.flatnonzero(cut)
        to = np.concatenate([at[1:], [len(who)]]) - 1
        open_ = (who[at[-1]], keep[at[-1]], start[at[-1]], reach[-1])
        at, to = at[:-1], to[:-1]
        yield _span_rows(who[at], start[at], reach[to], keep[at])
    if open_ is not None:
        yield _span_rows(*(np.array([x]) for x in (open_[0], open_[2], open_[3], open_[1])))


def _span_rows(who: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(keep.astype(bool))], ["id", "start_word", "end_word", "keep"])


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
    anchors = rows.select("k", "t").mapInArrow(lean(_anchors), "h long, k long, pos int")
    shared = anchors.repartition("h").sortWithinPartitions("h", "k", "pos").mapInArrow(lean(shared_places, 10_000), "k long, pos int")
    around = shared.groupBy("k").agg(F.collect_set("pos").alias("at"))
    found = (
        rows.join(around, "k", "left").select("k", "id", "t", F.coalesce("at", F.array().cast("array<int>")).alias("at"))
        .sortWithinPartitions("k", "id").mapInArrow(lean(_windows), "h long, id long, pos int, n int")
    )
    again = found.repartition("h").sortWithinPartitions("h", "id", "pos").mapInArrow(lean(_repeated, 10_000), "id long, pos int, n int, keep boolean")
    spans = again.repartition("id").sortWithinPartitions("id", "keep", "pos").mapInArrow(lean(spans_of, 10_000), "id long, start_word int, end_word int, keep boolean")
    return spans.withColumnRenamed("id", doc_id)
