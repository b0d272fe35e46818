"""Operator 4, quality classifier: an interpolated modified Kneser-Ney model of trusted text, over bytes.

The n-grams are of 1 to 5 bytes of UTF-8, for each language apart. All trusted documents (``quality`` 1 and not
``toxic`` among the labels) are counted: partial counts of each task are summed by key, so what is gathered grows with
the labelled text, while distinct n-grams of bytes become few to a byte of it. Continuation counts, discounts from counts
of counts, context totals and interpolated probabilities are aggregations and joins on (language, n-gram). The finished
table is sharded by hash into files in the shared folder; a scoring task joins its documents' distinct n-grams with one
shard after another by hashed look-up, so documents are never shuffled for it and a task's memory has a bound whatever
the model's size. The score is perplexity per byte.

Trusted text is divided into halves by its hash, and each half has a model. A document is scored by the model of the half
that its text would not be in, so no document is judged by a model that counted it, or a copy of it (but in a language
whose trusted text is all in one half). It is rejected when
its log-perplexity is beyond its language's fence, ``Q75 + FENCE * (Q75 - Q25)`` of the log-perplexities of the
language's trusted documents; so the fence doesn't move with the share of junk. The score of a short text is drawn towards
the median of those documents with the weight of ``PRIOR`` bytes, as a few bytes say little.

The labelled toxic text of a language has a model by the same code. As a few words hardly move the mean of a document,
its toxicity is the log of the likelihood ratio of the toxic to the trusted model over the worst ``SPAN`` bytes. It is
rejected beyond a fence of the toxicity of the trusted documents, with ``TOXIC_FENCE`` in place of ``FENCE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import CACHES, lean, new_path, pieces, small_batches, text_bytes, written

ORDER, FENCE, TOXIC_FENCE, PRIOR, SHARD_ROWS, BROADCAST_IDS = 5, 5.0, 5.0, 100, 1_500_000, 1_000_000
SPAN = 12
BEGIN = 2
CACHED_SHARDS, WALK_BYTES = 4, 32_000_000
#: What follows a language in the names of its models: the halves of the trusted text and the toxic text.
HALVES, TOXIC = ("\0a", "\0b"), "\0t"


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The ``order`` bytes that end at each byte, as one number; a row begins after order-1 bytes of BEGIN."""
    n = len(data)
    out = data.astype(np.uint64)
    pos = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        before = np.full(n, BEGIN, np.uint64)
        before[k:] = data[: max(0, n - k)]
        before[pos < k] = BEGIN
        out |= before << np.uint64(8 * k)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [z.compress(x.as_buffer()) for x in batch.column("t").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), batch.column("half"), pa.array(packed, pa.binary())], ["id", "lang", "half", "z"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest n-grams: a task's own sums, given out when they have grown large and at its end."""
    z = zstandard.ZstdDecompressor()
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        g, c = np.unique(grams(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])])), return_counts=True)
        if lang in held:
            g, at = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([held[lang][1], c])).astype(np.int64)
        held[lang] = (g, c)

    def give() -> Iterator[pa.RecordBatch]:
        for lang, (g, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "g", "c"])
        held.clear()

    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        raw = batch.column(1).type == pa.binary()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column(1)):
            waiting.setdefault(lang, []).append(z.decompress(text.as_buffer()) if raw else text.as_buffer().to_pybytes())
            size[lang] = size.get(lang, 0) + len(waiting[lang][-1])
            if size[lang] > 1_500_000:
                add(lang, waiting.pop(lang))
                size[lang] = 0
        for lang, texts in waiting.items():
            add(lang, texts)
        if sum(len(g) for g, _ in held.values()) > 2_000_000:
            yield from give()
    yield from give()


def _low(g: str, n: int) -> Column:
    return F.col(g).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def half_of(text: Column) -> Column:
    """0 or 1: the half of the trusted text that a text is in; copies are in one."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def known_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(id, trusted) of the documents to learn from. A trusted document isn't a toxic one, whatever other labels say."""
    trusted = F.coalesce(F.max(F.expr("quality = 1 AND coalesce(toxic, 0) = 0")), F.lit(False))
    known = labels.select(F.col(doc_id).cast("long").alias("id"), "quality", "toxic").groupBy("id")
    known = known.agg(trusted.alias("trusted"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic")).where("trusted OR toxic")
    return written(known.select("id", "trusted"), "labelled")


def labelled(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, t or z, part) of the documents to learn from: part 0 or 1 for the halves of the trusted ones, 2 for toxic ones."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("t")).where("id IS NOT NULL AND t <> ''")
    rows = rows.withColumn("half", half_of(F.col("t")))
    part = F.when(F.col("trusted"), F.col("half")).otherwise(F.lit(2)).alias("part")
    if known.count() <= BROADCAST_IDS:  # 9 bytes each; beyond that the texts are packed and shuffled
        return rows.join(F.broadcast(known), "id").select("lang", "t", part)
    return rows.mapInArrow(lean(_pack), "id long, lang string, half int, z binary").join(known, "id").select("lang", "z", part)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, n, g, lp, lb): log-probability of each n-gram and log-weight of what backs off from it as a context; either may be null.

    Each language has the models of its halves and of its toxic text, named by ``HALVES`` and ``TOXIC``.
    """
    return trained(labelled(docs, known_ids(labels, doc_id), doc_id, text, lang))


def trained(chosen: DataFrame) -> DataFrame:
    name = F.concat("lang", F.element_at(F.array(*map(F.lit, (*HALVES, TOXIC))), F.col("part") + 1))
    counts = chosen.select(name.alias("lang"), chosen.columns[1]).mapInArrow(lean(_count), "lang string, g long, c long")
    counted = written(counts.groupBy("lang", "g").agg(F.sum("c").alias("c")), "ngrams")
    orders = {ORDER: counted}
    for n in range(ORDER - 1, 0, -1):  # a shorter n-gram counts once for each byte that it is found behind
        orders[n] = written(orders[n + 1].groupBy("lang", _low("g", n).alias("g")).agg(F.count("*").alias("c")), f"ngrams{n}")
    lower, parts, weights = None, [], []
    for n in range(1, ORDER + 1):
        t = orders[n]
        k = [F.count(F.when(F.col("c") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
        d = t.groupBy("lang").agg(*[x.alias(f"k{i}") for i, x in enumerate(k, 1)])
        y = F.col("k1") / (F.col("k1") + 2 * F.col("k2"))

        def discount(i: int) -> Column:
            made = i - (i + 1) * y * F.col(f"k{i + 1}") / F.nullif(F.col(f"k{i}"), F.lit(0.0))
            return F.when((made > 0) & (made < i), made).otherwise(F.lit(i / 2)).alias(f"d{i}")

        d = d.select("lang", *[discount(i) for i in (1, 2, 3)])
        context = F.expr("shiftright(g, 8)")
        of = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(d), "lang").select("lang", "g", "c", of.alias("d"), context.alias("h"))  # a row for each language
        sums = t.groupBy("lang", "h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("back"))
        t = t.join(sums, ["lang", "h"])
        if lower is None:
            p = (F.col("c") - F.col("d")) / F.col("total") + F.col("back") / 256
            t = t.select("lang", "g", p.alias("p"))
        else:
            below = lower.select("lang", F.col("g").alias("s"), F.col("p").alias("q"))
            t = t.withColumn("s", _low("g", n - 1)).join(below, ["lang", "s"])
            t = t.select("lang", "g", ((F.col("c") - F.col("d")) / F.col("total") + F.col("back") * F.col("q")).alias("p"))
        lower = written(t, f"probabilities{n}")
        parts.append(lower.select("lang", F.lit(n).alias("n"), "g", F.log("p").alias("lp")))
        weights.append(sums.select("lang", F.lit(n - 1).alias("n"), F.col("h").alias("g"), F.log("back").alias("lb")))
    both = parts[0], weights[0]
    for p, w in zip(parts[1:], weights[1:]):
        both = both[0].unionByName(p), both[1].unionByName(w)
    return both[0].join(both[1], ["lang", "n", "g"], "full").select("lang", "n", "g", F.col("lp").cast("float").alias("lp"), F.col("lb").cast("float").alias("lb"))


class Model:
    """The shards of a trained model, as files in the shared folder.

    A row goes to the shard of its language and last two bytes, so that all n-grams that end at a byte are in one;
    those of one byte or none are in every shard.
    """

    def __init__(self, table: DataFrame, shard_rows: int = SHARD_ROWS) -> None:
        spark = table.sparkSession
        self.path = new_path(spark, "model")
        table = written(table, "model-rows")
        self.langs = {r.lang: i for i, r in enumerate(table.select("lang").distinct().orderBy("lang").toLocalIterator())}
        self.shards = max(1, -(-table.count() // shard_rows))
        names = F.create_map(*[F.lit(x) for pair in self.langs.items() for x in pair]) if self.langs else F.create_map(F.lit(""), F.lit(0))
        number = F.element_at(names, F.col("lang")).cast("long")
        spread = F.shiftright((number * 65536 + _low("g", 2)) * F.lit(2654435761) % F.lit(2**32), 8) % self.shards
        every = F.sequence(F.lit(0), F.lit(self.shards - 1))
        rows = table.withColumn("shard", F.explode(F.when(F.col("n") < 2, every).otherwise(F.array(spread.cast("int")))))
        rows.repartition("shard").write.partitionBy("shard").parquet(self.path)

    def shard(self, k: int) -> Shard:
        return _shard(self.path, k, tuple(self.langs))

    def _parts(self, tag: np.ndarray, g: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """(shard, the places whose n-grams are in it)."""
        if self.shards == 1:
            yield self.shard(0), np.arange(len(g))
            return
        low = (tag >> np.uint64(43)) * np.uint64(65536) + (g & np.uint64(0xFFFF))
        of = ((low * np.uint64(2654435761) & np.uint64(2**32 - 1)) >> np.uint64(8)) % np.uint64(self.shards)
        for k in range(self.shards):
            yield self.shard(k), np.flatnonzero(of == k)

    def score(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Sum of the log-probabilities of each row's bytes; ``lang`` numbers the rows' languages."""
        return by_row(next(self.bytewise([(data, offsets, lang)]))[0], offsets)

    def bytewise(self, parts: list[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
        """For each part (bytes, offsets, a numbering of the rows' languages or more) the log-probability of each byte by
        each numbering. The n-grams of all parts that the worker hasn't met are looked up together, once each; it
        remembers them by a place that their hash gives."""
        many, columns = np.uint64(len(self.langs) + 1), len(parts[0]) - 2
        kinds = []
        for part in parts:
            kind = np.zeros(len(part[1]) - 1, np.uint64)
            for lang in part[2:]:
                kind = kind * many + lang.astype(np.uint64)
            kinds.append(kind)
        fits = int(many) ** columns < 1 << 24
        if fits:
            memory = _remembered(self.path, columns)
        else:  # too many languages for a key: kinds are numbered for these parts only, and nothing is remembered
            every = np.unique(np.concatenate(kinds))
            kinds, memory = [np.searchsorted(every, k).astype(np.uint64) for k in kinds], _empty(columns, 4)
        seen, values = memory
        shift = np.uint64(65 - len(seen).bit_length())

        def keyed(part: tuple, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = grams(*part[:2]) | np.repeat(kind << np.uint64(40), np.diff(part[1]))
            slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            return key, slot, np.flatnonzero(seen[slot] != key)

        held = [keyed(*x) for x in zip(parts, kinds)] if len(parts) == 1 else None
        new = []
        for x in zip(parts, kinds):
            key, _, other = held[0] if held else keyed(*x)
            new.append(np.unique(key[other]))
        lead = np.unique(np.concatenate(new))
        rest, tags = lead >> np.uint64(40), []
        rest = rest if fits else every[rest.astype(np.int64)]
        for _ in range(columns):
            tags.insert(0, rest % many << np.uint64(43))
            rest = rest // many
        found = self._known(np.tile(lead & np.uint64((1 << 40) - 1), columns), np.concatenate(tags)).reshape(columns, -1)
        for x in zip(parts, kinds):
            key, slot, other = held[0] if held else keyed(*x)
            at = np.searchsorted(lead, key[other])
            out = [v[slot] for v in values]
            for mine, theirs in zip(out, found):
                mine[other] = theirs[at]
            yield out
        place = ((lead * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
        seen[place] = lead
        for mine, theirs in zip(values, found):
            mine[place] = theirs

    def _known(self, g: np.ndarray, tag: np.ndarray) -> np.ndarray:
        n = len(g)
        total, longest = np.full(n, -np.log(256), np.float32), np.zeros(n, np.int8)
        for shard, rest in self._parts(tag, g):  # a byte is settled by the longest n-gram that is known
            for order in range(ORDER, 0, -1):
                lp = shard.find(tag[rest] | np.uint64(order << 40) | g[rest] & np.uint64((1 << (8 * order)) - 1), 0)
                known = ~np.isnan(lp)
                total[rest[known]] = lp[known]
                longest[rest[known]] = order
                rest = rest[~known]
        short = np.flatnonzero(longest < ORDER)
        tag, g, longest = tag[short], g[short] >> np.uint64(8), longest[short]
        back = np.zeros(len(short), np.float32)
        for shard, some in self._parts(tag, g):  # and the weights of the longer contexts
            for order in range(ORDER - 1, -1, -1):
                of = some[longest[some] <= order]
                back[of] += np.nan_to_num(shard.find(tag[of] | np.uint64(order << 40) | g[of] & np.uint64((1 << (8 * order)) - 1), 1))
        total[short] += back
        return total


def by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def worst_span(values: np.ndarray, offsets: np.ndarray, size: int = SPAN) -> np.ndarray:
    """The greatest sum of ``size`` values in a row in each row, or of the first ones; 0 for an empty row."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    start = np.repeat(offsets[:-1], np.diff(offsets))
    end = np.arange(1, len(values) + 1)
    spans = sums[end] - sums[np.maximum(end - size, start)]
    out = np.zeros(len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(spans, offsets[some])
    return out


class Shard:
    """A hash table of (language, order, n-gram)."""

    def __init__(self, keys: np.ndarray, values: tuple[np.ndarray, np.ndarray]) -> None:
        self.bits = max(4, int(len(keys) * 2).bit_length())
        size = 1 << self.bits
        self.key, self.values = np.full(size, np.uint64(2**64 - 1)), (np.full(size, np.nan, np.float32), np.full(size, np.nan, np.float32))
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.key[at] == np.uint64(2**64 - 1)
            _, lead = np.unique(at, return_index=True)
            takes = np.zeros(len(left), bool)
            takes[lead] = True
            takes &= free
            self.key[at[takes]] = keys[left[takes]]
            for mine, given in zip(self.values, values):
                mine[at[takes]] = given[left[takes]]
            left = left[~takes]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, slot, -1)
        left = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def find(self, keys: np.ndarray, column: int) -> np.ndarray:
        at = self.places(keys)
        return np.where(at >= 0, self.values[column][at], np.float32(np.nan))


@lru_cache(maxsize=CACHED_SHARDS)
def _shard(path: str, k: int, langs: tuple[str, ...]) -> Shard:
    fs, root = pafs.FileSystem.from_uri(path)
    found = [x.path for x in fs.get_file_info(pafs.FileSelector(f"{root}/shard={k}", allow_not_found=True)) if x.path.endswith(".parquet")]
    tables = [pq.ParquetFile(fs.open_input_file(x)).read(["lang", "n", "g", "lp", "lb"]) for x in found]
    if not tables:
        return Shard(np.zeros(0, np.uint64), (np.zeros(0, np.float32), np.zeros(0, np.float32)))
    t = pa.concat_tables(tables)
    number = {x: i for i, x in enumerate(langs)}
    names = t["lang"].combine_chunks().dictionary_encode()
    tag = np.array([number[x] for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
    keys = tag << np.uint64(43) | t["n"].to_numpy().astype(np.uint64) << np.uint64(40) | t["g"].to_numpy().view(np.uint64)
    return Shard(keys, tuple(t[c].to_numpy().astype(np.float32) for c in ("lp", "lb")))


MEMORY_BITS = 21


def _empty(columns: int, bits: int = MEMORY_BITS) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.full(1 << bits, np.uint64(2**64 - 1)), [np.zeros(1 << bits, np.float32) for _ in range(columns)]


@lru_cache(maxsize=1)
def _remembered(path: str, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A worker's n-grams and their values; of two with one place the later stays."""
    return _empty(columns)


def _forget() -> None:
    _shard.cache_clear()
    _remembered.cache_clear()


CACHES["model"] = _forget


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) of ``docs`` in a struct ``r`` with the id, language ``l``, bytes ``nb``, sum of
    log-probabilities ``ll`` and toxicity ``tox``; null where there is no model or text. A text is scored by the model
    of the half that it isn't in."""
    small_batches(docs.sparkSession)
    carry = carry or docs.columns
    inside = text in carry  # then the text travels once
    rows = docs.select(
        F.struct(*carry).alias("r"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"), half_of(F.col(text)).alias("half"), *([] if inside else [F.col(text).alias("t")])
    )

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches that are scored in one walk through the shards: each by itself while a worker holds all shards."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if model.shards <= CACHED_SHARDS or size > WALK_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in together(batches):
            rows, parts = [], []
            for batch in group:
                data, offsets = text_bytes(batch.column("r").field(carry.index(text)) if inside else batch.column("t"))
                names, half = batch.column("l").to_pylist(), batch.column("half").to_pylist()
                good = np.array([model.langs.get(x + HALVES[1 - (h or 0)], model.langs.get(x + HALVES[h or 0], -1)) for x, h in zip(names, half)], np.int64)
                bad = np.array([model.langs.get(x + TOXIC, -1) for x in names], np.int64)
                cuts = list(pieces(offsets))
                rows.append((batch, offsets, good, bad, cuts))
                parts += [(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.maximum(good[lo:hi], 0), np.maximum(bad[lo:hi], 0)) for lo, hi in cuts]
            bytewise = zip(parts, model.bytewise(parts)) if parts else iter(())
            for batch, offsets, good, bad, cuts in rows:
                ll, ratio = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for lo, hi in cuts:
                    (_, at, *_), (p, q) = next(bytewise)
                    ll[lo:hi], ratio[lo:hi] = by_row(p, at), worst_span(q - p, at)
                size = np.diff(offsets)
                none = (good < 0) | (size == 0)
                columns = [pa.array(size), pa.array(ll, mask=none), pa.array(ratio, mask=none | (bad < 0))]
                yield pa.RecordBatch.from_arrays([batch.column("r"), batch.column("id"), batch.column("l"), *columns], ["r", "id", "l", "nb", "ll", "tox"])
            next(bytewise, None)  # lets it remember what it has found

    schema = T.StructType([*rows.select("r", "id", "l").schema.fields, T.StructField("nb", T.LongType()), T.StructField("ll", T.DoubleType()), T.StructField("tox", T.DoubleType())])
    return rows.mapInArrow(lean(run, keep="model"), schema)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fence: float = FENCE, carry: list[str] | None = None, toxic_fence: float = TOXIC_FENCE) -> DataFrame:
    """(r, perplexity, score, threshold, toxicity, toxic_threshold, keep) for every row of ``docs``, r the row or its columns ``carry``.

    Kept without a score: a null or empty text, and a language without trusted text (a null language is one of its
    own). Labels with null values aren't trusted; a document with several labels is trusted if one of them says so.
    Repeated rows are each scored. Extra columns of any name travel in ``r``. Empty tables give an empty one, and without labels every row is kept. Texts are
    scored to their end. A language without toxic labels has no toxicity.
    """
    known = known_ids(labels, doc_id)
    model = Model(trained(labelled(docs, known, doc_id, text, lang)))
    table = written(scored(docs, model, doc_id, text, lang, carry).withColumn("h", -F.col("ll") / F.col("nb")), "scored")
    sample = table.select("id", "l", "nb", "ll", "h", "tox").where("ll IS NOT NULL").join(known.where("trusted"), "id", "left_semi")
    middle = written(sample.groupBy("l").agg(F.percentile_approx("h", F.lit(0.5), F.lit(10_000)).alias("mid")), "medians")
    drawn = (-F.col("ll") + PRIOR * F.col("mid")) / (F.col("nb") + PRIOR)

    def limit(column: str, width: float) -> Column:
        q = F.percentile_approx(column, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
        return q[1] + width * (q[1] - q[0])

    limits = sample.join(F.broadcast(middle), "l").withColumn("s", drawn).groupBy("l", "mid").agg(limit("s", fence).alias("most"), limit("tox", toxic_fence).alias("worst"))
    limits = written(limits, "limits")  # a row for each language, and so broadcast
    table = table.join(F.broadcast(limits), "l", "left").withColumn("s", drawn)
    keep = F.coalesce(F.col("s") <= F.col("most"), F.lit(True)) & F.coalesce(F.col("tox") <= F.col("worst"), F.lit(True))
    return table.select(
        "r", F.exp("h").alias("perplexity"), F.exp("s").alias("score"), F.exp("most").alias("threshold"), F.col("tox").alias("toxicity"), F.col("worst").alias("toxic_threshold"), keep.alias("keep")
    )


def quality_filter(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fence: float = FENCE) -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects, with all columns; nulls, empty and very long texts, repeated rows,
    ties (a score at its threshold stays) and empty tables as there."""
    return judged(docs, labels, doc_id, text, lang, fence).where("keep").select(*[F.col("r")[c].alias(c) for c in docs.columns])
