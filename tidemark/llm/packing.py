"""Operator 7, best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are divided into chunks of at most ``CAPACITY`` tokens, and chunks are put, longest first, into the open bin
with the least room that is enough (the oldest of equals), or a new one. The tree has a leaf for each remaining capacity; a descent finds the
tightest open bin in logarithmic time. Chunks of one length are alike, so the whole corpus is packed from its histogram
of lengths: while a length lasts, the tightest bin stays the tightest for it, and bins with equal room are handled as a
range. That gives the packing that handling chunks one by one gives, in time and memory that depend on the capacity and
not on the corpus. A chunk then finds its bin from its rank among those of its length; ranks come from counts per
(length, bucket), so the many full chunks of a large corpus are not ranked in one place. Bins are packed over all
data, not within partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import lean, small_batches, written
from tidemark.llm.tokens import TOKENIZERS, VOCABULARY, Tokens

CAPACITY = 2048
BUCKET_ROWS = 200_000


class SegmentTree:
    """How many of the leaves from 0 to ``size`` below a node are not empty; finds the first one from a place on."""

    def __init__(self, size: int) -> None:
        self.width = 1 << max(1, size).bit_length()
        self.full = [0] * (2 * self.width)

    def set(self, leaf: int, filled: bool) -> None:
        i = leaf + self.width
        if self.full[i] == filled:
            return
        step = 1 if filled else -1
        while i:
            self.full[i] += step
            i >>= 1

    def first_from(self, leaf: int) -> int:
        """The least filled leaf that is not below ``leaf``; -1 if there is none."""
        i = leaf + self.width
        while not self.full[i]:
            while i & 1:  # a right child: go up
                i >>= 1
                if i == 0:
                    return -1
            if i == 0:
                return -1
            i += 1
        while i < self.width:
            i *= 2
            if not self.full[i]:
                i += 1
        return i - self.width


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first bin, chunks to a bin, offset in the bin) for runs of equal chunks, from their numbers."""
    tree = SegmentTree(capacity)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> ranges of bins (first, how many)
    out, bins = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            heapq.heappush(open_[room], (first, many))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            room = tree.first_from(length)
            if room < 0 or room > capacity:
                room, each = capacity, capacity // length
                first, many = bins, -(-rest // each)
                bins += many
            else:
                each = room // length
                first, have = heapq.heappop(open_[room])
                many = min(have, -(-rest // each))
                if have > many:
                    heapq.heappush(open_[room], (first + many, have - many))
                elif not open_[room]:
                    tree.set(room, False)
            placed = min(rest, many * each)
            out.append((length, rank, first, each, capacity - room))
            whole = placed // each
            put(room - each * length, first, whole)
            if whole < many:
                put(room - (placed - whole * each) * length, first + whole, 1)
            rank += placed
            rest -= placed
    return out


def token_counts(docs: DataFrame, doc_id: str, text: str, folder: str, name: str) -> DataFrame:
    """(id, x, n): document, hash of its text, number of its tokens."""
    small_batches(docs.sparkSession)
    tokens = Tokens(docs.sparkSession, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder()
        for batch in batches:
            n = [len(encode(x.as_py())) for x in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(n, pa.int64())], ["id", "x", "n"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("x"), F.col(text).alias("t")).where("t <> ''")
    return rows.mapInArrow(lean(run, keep="tokens"), "id long, x long, n long")


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(bin_id, bin_offset, doc_id, chunk, token_start, n_tokens): every token of ``docs`` in a place of its own.

    Chunks of a document are numbered from 0. A null or empty text has no tokens and no row; a null id stays null;
    repeated rows are packed each; ties among equal lengths are broken by hash, id and chunk. A text
    of any length is divided, runs of white space too. An empty table gives an empty one. Columns other than the two are never read. ``doc_id`` must be an integer.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counted = written(token_counts(docs, doc_id, text, folder, name), "token_counts")
    chunks = counted.select(
        "id", "x", F.posexplode(F.expr(f"transform(sequence(1L, (n + {capacity} - 1) div {capacity}), i -> least({capacity}L, n - (i - 1) * {capacity}))")).alias("chunk", "length")
    )
    total = counted.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    buckets = max(1, int(total) // BUCKET_ROWS)
    chunks = chunks.withColumn("b", F.pmod(F.xxhash64("id", "x", "chunk"), F.lit(buckets)))
    sizes = written(chunks.groupBy("length", "b").agg(F.count("*").alias("many")), "sizes")
    counts = {r.length: r.many for r in sizes.groupBy("length").agg(F.sum("many").alias("many")).toLocalIterator()}
    runs = plan(counts, capacity)  # one row or a few for each length, whatever the corpus
    runs.sort()
    table = [np.array([(length << 44) + rank for length, rank, *_ in runs], np.int64)]
    table += [np.array([r[k] for r in runs], np.int64) for k in (2, 3, 4)]
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = sizes.select("length", "b", (F.sum("many").over(Window.partitionBy("length").orderBy("b")) - F.col("many")).alias("before"))
    ranked = (
        chunks.join(before, ["length", "b"])
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "b").orderBy("id", "x", "chunk")) - 1)
        .select("id", "chunk", "length", "rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, each, offset = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(key, (length << 44) + rank, "right") - 1
            i = rank - (key[run] & ((1 << 44) - 1))
            at = batch.column("chunk").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[run] + i // each[run]), pa.array(offset[run] + i % each[run] * length), batch.column("id"), batch.column("chunk"), pa.array(at * capacity), batch.column("length")],
                ["bin_id", "bin_offset", "id", "chunk", "token_start", "n_tokens"],
            )

    return ranked.mapInArrow(lean(place, 10_000), "bin_id long, bin_offset long, id long, chunk int, token_start long, n_tokens long").withColumnRenamed("id", doc_id)
