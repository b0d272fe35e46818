"""Shared helpers: the shared work folder, written intermediate tables, and byte-level text kernels.

The kernels work on Arrow's UTF-8 buffers with numpy, so no Python string is made for a document. A *word* is a
maximal run of bytes that are not ASCII white space (0x09-0x0D, 0x1C-0x20).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import _made, new_path, remove, shared_dir, ship, stored

work_dir = shared_dir


#: A table in the shared folder: lineage ends there and a lost executor costs no recomputation.
written = stored


BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand documents to Python by at most ``BATCH_ROWS`` in this session: 10,000 long texts at once would be
    held several times over, in the executor and in its Python workers. Sends the workers this package, too."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: What a worker keeps between tasks, by operator: a function that drops it.
CACHES: dict[str, Callable[[], None]] = {}


def lean(run: Callable, rows: int = 1000, keep: str = "") -> Callable:
    """``run`` over slices of at most ``rows`` rows, for mapInArrow. A worker lives on from operator to operator, so it
    drops what others left before it begins, and gives free memory back when it ends."""

    def trimmed() -> None:
        for name, drop in CACHES.items():
            if name != keep:
                drop()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only the GNU library has it
            pass

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)
            del batch

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        try:
            yield from run(slices(batches))
        finally:
            trimmed()

    return whole


def content_key(text: Column) -> Column:
    """128 bits and more that stand for a text."""
    return F.struct(
        F.xxhash64(text).alias("x"), F.hash(text).alias("m"), F.octet_length(text).alias("n")
    )


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    bufs = column.buffers()
    if n == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; every row is in one range."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


SPACE = np.zeros(256, bool)
SPACE[[*range(9, 14), *range(28, 33)]] = True
_rng = np.random.Generator(np.random.PCG64(20260101))
_BYTE = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_pow: dict[int, np.ndarray] = {}
CACHES["powers"] = _pow.clear


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base % 2**64), np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:  # an unusually long text doesn't leave its table behind
            _pow[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and the Chinese characters.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, the one after the last) of every character of UNSPACED."""
    at = np.flatnonzero(data >= 0xE0)
    wide = 3 + (data[at] >= 0xF0)
    at, wide = at[at + wide <= len(data)], wide[at + wide <= len(data)]
    low = [data[at + k].astype(np.int64) & 0x3F for k in (1, 2)]
    three = (data[at].astype(np.int64) & 0x0F) << 12 | low[0] << 6 | low[1]
    last = data[np.minimum(at + 3, len(data) - 1)].astype(np.int64) & 0x3F
    point = np.where(wide == 3, three, (data[at].astype(np.int64) & 0x07) << 18 | low[0] << 12 | low[1] << 6 | last)
    some = np.zeros(len(at), bool)
    for lo, hi in UNSPACED:
        some |= (point >= lo) & (point <= hi)
    return at[some], (at + wide)[some]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, lone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row): byte bounds of all words; rows never share a word. With ``lone`` each
    character of a script without spaces is a word by itself."""
    n = len(data)
    solid = np.empty(n + 1, bool)
    solid[:n] = ~gap[data]
    solid[n] = False
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = solid[:n]
    breaks = offsets[(offsets > 0) & (offsets < n)]
    starts = solid & ~before
    starts[breaks] = solid[breaks]
    ends = before & ~solid
    ends[breaks] = before[breaks]
    if lone and n:
        a, e = unspaced(data)
        starts[a] = ends[e] = True
        starts[e] |= solid[e]
        ends[a] |= before[a]
        starts[breaks], ends[breaks] = solid[breaks], before[breaks]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word's bytes (after ``table``), the same wherever the word stands."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(table[data], powers(n, _P), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * powers(n + 1, _PINV)[start])


_W = 0xD6E8FEB86659FD93
_WINV = pow(_W, -1, 2**64)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` values of ``h``, by a rolling polynomial."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(h, powers(n, _W), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[size:] - sums[:-size]) * powers(n - size + 1, _WINV))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, in place of bytes of UTF-8."""
    out = _LOWER[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
    out[upper] += 32
    return out


NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the graph of ``pairs``: (node, root), root the least node of its component.

    Large-star and small-star rounds, which end after a logarithmic number of rounds in practice; each round is a few
    aggregations and joins on node ids, written to the shared folder, and the round before is then deleted. Nulls
    and loops are ignored.
    """
    spark = pairs.sparkSession
    edges = written(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "edges",
    )
    old, mark = _made[-1][1], None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, old)
        old = _made[-1][1]
        if now == mark:
            break
        mark = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
