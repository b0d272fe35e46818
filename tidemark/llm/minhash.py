"""Operator 10, MinHash near-dedup by an LSH forest.

Each document has 128 min-hashes of its distinct runs of three words (lower case, ASCII punctuation apart; a
character of a script without spaces is a word). Sixteen trees
hold eight of them each as a label: a tree is the documents in the sorted order of their labels, so that documents with
a long common prefix are neighbours. A region of the order descends to the least depth at which it has at most ``LEAF``
documents, and there all of its pairs are candidates; neighbours are candidates at any depth. Regions that are larger
are no leaf, at whatever depth; each is also compared with centres: the member nearest to what most members have in
each place of the signature, then that of those it left, as long as a centre takes an eighth of the rest. So the copies
of one document find it even if they are unlike one another, in time that is linear in the region, and what is left has
been descended into. Where a label is equal as a whole, those left are neighbours by the labels of the other trees.

A candidate counts when its estimated Jaccard similarity is at least the threshold less ``MARGIN``, about the
estimate's standard deviation. Signatures travel with the labels, so a pair is judged where it is found. Documents with
the same signature are one node of the forest. A region of one first value is in one task, whatever the number of
partitions, and is read by blocks of ``BLOCK`` rows that end between leaves; its centres are carried from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, fold, lean, mix, NOT_ALNUM, pieces, small_batches, text_bytes, window_hashes, word_hashes, words, written

SHINGLE, HASHES, TREES, DEPTH, LEAF, THRESHOLD, MARGIN = 3, 128, 16, 8, 24, 0.5, 0.045
BLOCK, CENTRES = 40_000, 8
_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every run of ``size`` words, first run of each row). A shorter text is one run of all its words."""
    data = fold(data)
    start, end, first = words(data, offsets, NOT_ALNUM, lone=True)
    h = word_hashes(data, start, end)
    n = np.diff(first)
    runs = window_hashes(h, size)
    ok = np.ones(len(runs), bool)
    for k in range(1, size):  # runs that cross into the next row
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(runs))]] = False
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.array([int(mix(np.bitwise_xor.reduce(h[first[r] : first[r + 1]] * np.arange(3, 3 + 2 * n[r], 2, np.uint64), keepdims=True))[0]) for r in short], np.uint64)
    row = np.searchsorted(first, np.arange(len(runs)), "right") - 1
    rows = np.concatenate([row[ok], short])
    value = np.concatenate([runs[ok], extra])
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, value = rows[order], value[order]
    return (value >> np.uint64(32)).astype(np.uint32), np.searchsorted(rows, np.arange(len(offsets)))


def signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows with a run, HASHES) least values of the runs' hashes under each permutation."""
    some = first[:-1][np.diff(first) > 0]
    out = np.empty((len(some), HASHES), np.uint32)
    if len(some):
        for k in range(HASHES):
            x = h * _A[k]
            x ^= x >> np.uint32(15)
            x *= _B[k] | np.uint32(1)
            out[:, k] = np.minimum.reduceat(x, some)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("t"))
        for lo, hi in pieces(offsets):
            at = offsets[lo : hi + 1]
            h, first = shingles(data[at[0] : at[-1]], at - at[0])
            some = np.flatnonzero(np.diff(first) > 0)
            sig = signature(h, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(lo, hi - lo).take(pa.array(some)), _fixed(sig.astype(">u4")), _fixed(sig.astype(np.uint8))], ["id", "sig", "low"]
            )


def _fixed(rows: np.ndarray) -> pa.Array:
    """A row of a matrix as a binary value."""
    wide = rows.shape[1] * rows.dtype.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * wide
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def similar(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows a and b of a matrix of the signatures' low bytes."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        same = (low[a[i : i + (1 << 15)]] == low[b[i : i + (1 << 15)]]).mean(axis=1)
        out[i : i + (1 << 15)] = (same - 1 / 256) / (1 - 1 / 256)
    return out


def regions(label: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Candidates (i, j) of rows in sorted order, and (from, to, depth) of every region that is larger than a leaf; of
    equal ranges the deepest. Rows of unlike first values have no pair."""
    n, depth = label.shape
    same = label[1:] == label[:-1]
    common = np.where(same.all(axis=1), depth, np.argmin(same, axis=1)) if n > 1 else np.zeros(0, np.int64)
    of = np.full(n, -1, np.int64)
    large: dict[tuple[int, int], int] = {}
    for d in range(1, depth + 1):
        part = np.concatenate([[0], np.cumsum(common < d)])
        size = np.bincount(part)
        fits = (size[part] <= leaf) & (of < 0)
        of[fits] = part[fits] * (depth + 1) + d
        first = np.cumsum(size) - size
        for k in np.flatnonzero(size > leaf):
            large[int(first[k]), int(first[k] + size[k])] = d
    near = np.flatnonzero(common >= 1)
    left, right = [near], [near + 1]
    for k in range(2, leaf):
        i = np.flatnonzero((of[:-k] == of[k:]) & (of[k:] >= 0))
        left.append(i)
        right.append(i + k)
    return np.concatenate(left), np.concatenate(right), [(a, b, d) for (a, b), d in large.items()]


def around(low: np.ndarray, at: np.ndarray, threshold: float) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """[(centre, rows near it)] of the rows ``at`` of a region, and the rows that no centre took."""
    found, rest = [], at
    while len(rest) > 1:
        some = low[rest].astype(np.int64) + 256 * np.arange(low.shape[1])
        most = np.bincount(some.ravel(), minlength=256 * low.shape[1]).reshape(-1, 256).argmax(axis=1).astype(np.uint8)
        centre = int(at[np.argmax((low[at] == most).sum(axis=1))])
        near = similar(low, np.full(len(rest), centre), rest) >= threshold
        near &= rest != centre
        if near.any():
            found.append((centre, rest[near]))
        rest = rest[~near & (rest != centre)]
        if near.sum() * 8 < len(rest):
            break
    return found, rest


def judge(label: np.ndarray, low: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of the candidates at or above the threshold among rows in sorted order, and rows that were centres, the last first."""
    i, j, large = regions(label)
    ok = similar(low, i, j) >= threshold
    left, right, centres = [i[ok]], [j[ok]], []
    for lo, hi, d in large:
        found, rest = around(low, np.arange(lo, hi), threshold)
        for centre, near in found:
            left.append(np.full(len(near), centre))
            right.append(near)
            centres.append((len(near), centre))
        if d == label.shape[1]:
            for t in range(0, low.shape[1], d):
                order = rest[np.lexsort(low[rest, t : t + d].T[::-1])]
                for k in (1, 2, 3):
                    a, b = order[:-k], order[k:]
                    ok = similar(low, a, b) >= threshold
                    left.append(a[ok])
                    right.append(b[ok])
    best = list(dict.fromkeys(c for _, c in sorted(centres, reverse=True)))[:CENTRES]
    return np.concatenate(left), np.concatenate(right), np.array(best, np.int64)


def block_end(label: np.ndarray) -> int:
    """Where a block of one region may end, in its second half: between the rows whose common prefix is the shortest."""
    half = len(label) // 2
    same = label[half + 1 :] == label[half:-1]
    common = np.where(same.all(axis=1), label.shape[1], np.argmin(same, axis=1))
    return half + 1 + int(np.argmin(common))


def _pairs(batches: Iterator[pa.RecordBatch], threshold: float, block: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of near nodes among rows sorted by tree and label, all rows of a first value among them."""
    block = block or BLOCK
    held: list[tuple[np.ndarray, ...]] = []  # node, tree, label, low
    kept: tuple[np.ndarray, np.ndarray, tuple] | None = None  # centres of a region that goes on: node, low, (tree, first value)

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return batch.column("node").to_numpy(), batch.column("tree").to_numpy(), _matrix(batch.column("label"), ">u4"), _matrix(batch.column("low"), "u1")

    def of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def done(rows: tuple[np.ndarray, ...], goes_on: bool) -> pa.RecordBatch:
        nonlocal kept
        node, tree, label, low = rows
        key = (int(tree[0]), int(label[0, 0]))
        label = np.concatenate([label[:, :1] ^ tree[:, None].astype(np.uint32) * np.uint32(0x9E3779B1), label[:, 1:]], axis=1) if tree[0] != tree[-1] else label
        i, j, centres = judge(label, low, threshold)
        a, b = [node[i]], [node[j]]
        if kept and kept[2] == key:
            here = np.arange(int(np.searchsorted(np.cumsum(label[:, 0] != label[0, 0]), 1)))
            both = np.concatenate([kept[1], low[here]])
            for k, centre in enumerate(kept[0]):
                near = here[similar(both, np.full(len(here), k), here + len(kept[0])) >= threshold]
                a.append(np.full(len(near), centre))
                b.append(node[near])
        else:
            kept = None
        if goes_on:
            mine = (node[centres], low[centres], key)
            kept = mine if kept is None else (np.concatenate([kept[0], mine[0]])[:CENTRES], np.concatenate([kept[1], mine[1]])[:CENTRES], key)
        else:
            kept = None
        return of(np.concatenate(a), np.concatenate(b))

    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(rows_of(batch))
        count += batch.num_rows
        if count < block:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held))
        change = np.flatnonzero((rows[2][1:, 0] != rows[2][:-1, 0]) | (rows[1][1:] != rows[1][:-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:  # whole regions, up to the last change of the first value
            yield done(tuple(x[:last] for x in rows), False)
        if count - last >= block:
            cut = last + block_end(rows[2][last:])
            yield done(tuple(x[last:cut] for x in rows), True)
            last = cut
        held = [tuple(x[last:].copy() for x in rows)]
        count -= last
    if count:
        yield done(tuple(np.concatenate(x) for x in zip(*held)), False)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near duplicate; group_id is the group's least doc_id.

    Groups are the connected components of the pairs whose estimated similarity reaches ``threshold`` less ``MARGIN``.
    Rows with a null id or text, or without a letter or digit, are in no group. Rows that repeat id and text are one
    document; rows that repeat an id with other texts are one document, too, near whatever one of them is near. Texts
    are read whole, however long; ties don't occur, as ids order a group. An empty table gives an empty one. Columns besides the two are
    never read, whatever their names. ``doc_id`` must be an integer.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    signed = written(
        rows.mapInArrow(lean(_sign), "id long, sig binary, low binary").withColumn("k", F.struct(F.xxhash64("sig").alias("x"), F.hash("sig").alias("m"))),
        "signatures",
    )
    nodes = written(signed.groupBy("k").agg(F.min("id").alias("node"), F.first("sig").alias("sig"), F.first("low").alias("low")), "nodes")
    wide = 4 * DEPTH
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(sig, {t * wide + 1}, {wide})").alias("label")) for t in range(TREES)]))
    order = (
        nodes.select("node", "low", trees.alias("x")).select("node", "low", "x.tree", "x.label")
        .repartition("tree", F.substring("label", 1, 4)).sortWithinPartitions("tree", "label", "node")
    )
    pairs = order.mapInArrow(lean(lambda it: _pairs(it, threshold - MARGIN), 10_000), "a long, b long")
    twins = signed.join(nodes.select("k", "node"), "k").where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    groups = components(pairs.unionByName(twins))
    return groups.select(F.col("node").alias(doc_id), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents of a group but the one with its least id. Rows in no group, rows with a null id
    or text among them, all stay, repeated ones too, with all columns, whatever their names; so do all rows of the id
    that stays. An empty table gives an empty one."""
    found = near_duplicates(docs, doc_id, text, threshold)
    gone = found.where("NOT keep").select(F.col(doc_id).alias("gone"))
    rows = docs.select(F.struct("*").alias("r"))
    return rows.join(gone, F.col("r")[doc_id] == F.col("gone"), "left_anti").select(*[F.col("r")[c].alias(c) for c in docs.columns])
