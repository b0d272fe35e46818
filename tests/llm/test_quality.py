"""The language model against a plain definition of modified Kneser-Ney, and the classifier on held-out labels."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

N = quality.ORDER


def reference_model(texts):
    """log p(byte | up to N-1 bytes before it), interpolated modified Kneser-Ney over dicts."""
    top = Counter()
    for t in texts:
        b = bytes([quality.BEGIN]) * (N - 1) + t.encode()
        for i in range(N - 1, len(b)):
            top[b[i - N + 1 : i + 1]] += 1
    orders = {N: top}
    for n in range(N - 1, 0, -1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    disc, ctx = {}, {}
    for n, t in orders.items():
        k = [0, *(sum(c == i for c in t.values()) for i in (1, 2, 3, 4))]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else None
        d = []
        for i in (1, 2, 3):
            v = i - (i + 1) * y * k[i + 1] / k[i] if y is not None and k[i] else -1
            d.append(v if 0 < v < i else i / 2)
        disc[n] = lambda c, d=d: d[min(c, 3) - 1]
        s = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            s[g[:-1]][0] += c
            s[g[:-1]][1] += disc[n](c)
        ctx[n] = s

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        total, lost = ctx[n].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        c = orders[n].get(g, 0)
        return (max(0, c - disc[n](c)) if c else 0) / total + lost / total * p(g[1:])

    def score(text):
        b = bytes([quality.BEGIN]) * (N - 1) + text.encode()
        return sum(math.log(p(b[i - N + 1 : i + 1])) for i in range(N - 1, len(b)))

    return score


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("shard_rows,ids", [(quality.SHARD_ROWS, quality.BROADCAST_IDS), (1500, 0)])
def test_equals_the_definition(spark, tables, monkeypatch, shard_rows, ids):
    docs, labels = tables
    monkeypatch.setattr(quality, "BROADCAST_IDS", ids)
    docs = docs.where("lang in ('de', 'es')").withColumn("text", F.substring("text", 1, 700))
    table = quality.train(docs, labels)
    model = quality.Model(table, shard_rows)
    assert (model.shards > quality.CACHED_SHARDS) == (shard_rows == 1500)
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    extra = spark.createDataFrame([(10**6, "### zzz @@ 中文", "de"), (10**6 + 1, "A", "es")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    rows = both.withColumn("half", quality.half_of(F.col("text"))).collect()
    halves = {(k, h): [r.text for r in rows if r.lang == k and r.half == h and r.doc_id in good] for k in ("de", "es") for h in (0, 1)}
    want = {(k, h): reference_model(halves[k, h] or halves[k, 1 - h]) for k, h in halves}
    got = {r.r.doc_id: r.ll for r in quality.scored(both, model).collect()}
    for r in [*rows[:12], *rows[-2:]]:
        assert got[r.doc_id] == pytest.approx(want[r.lang, 1 - r.half](r.text), rel=1e-4, abs=1e-3)


def test_many_languages_and_memory(spark, tables, monkeypatch):
    docs, labels = tables
    model = quality.Model(quality.train(docs.where("lang in ('de', 'en')").withColumn("text", F.substring("text", 1, 400)), labels))
    texts = [b"Der die das", b"the of and", b"the of and", "ß中".encode(), b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    a, b = np.array([0, 1, 2, 0, 1]), np.array([1, 1, 0, 2, 2])
    part = (data, offsets, a, b)
    first = list(model.bytewise([part, part]))
    monkeypatch.setattr(quality, "MEMORY_BITS", 3)
    quality.CACHES["model"]()
    small = list(model.bytewise([part, part])) + list(model.bytewise([part]))
    model.langs |= {f"x{k}": 100 + k for k in range(5000)}
    wide = list(model.bytewise([part, part]))
    for out in [*first, *small, *wide]:
        for mine, want in zip(out, first[0]):
            assert np.array_equal(mine, want)
    quality.CACHES["model"]()


def test_probabilities_sum_to_one(tables):
    docs, labels = tables
    model = quality.Model(quality.train(docs.where("lang = 'en'"), labels))
    history = b"the "
    data = np.frombuffer(b"".join(history + bytes([c]) for c in range(256)), np.uint8)
    whole = model.score(data, np.arange(257) * 5, np.zeros(256, np.int64))
    start = np.frombuffer(history, np.uint8)
    before = model.score(start, np.array([0, 4]), np.zeros(1, np.int64))[0]
    assert np.exp(whole - before).sum() == pytest.approx(1, abs=1e-3)


def test_held_out(spark, sf):
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")  # the smallest table has three poor documents held out
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, labels.where("doc_id % 2 = 0"), carry=["doc_id"]).select("r.doc_id", "keep")
    rows = out.join(labels.where("doc_id % 2 = 1 AND toxic = 0"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert len(good) > 20 and np.mean(good) >= 0.97
    assert len(bad) > 10 and np.mean(bad) <= 0.3


def test_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(90001, None, "en", 1), (90002, "", "en", 1), (90003, "Fjord og fjell.", "no", 1), (90004, "x", None, 1), (None, "The and of.", "en", 1), (90005, "### $$$ &&& " * 5000, "en", 1)], "doc_id long, text string, lang string, l int")
    more = docs.select("doc_id", "text", "lang", F.lit(1).alias("l")).unionByName(odd).unionByName(odd)
    out = quality.quality_filter(more, labels.unionByName(spark.createDataFrame([(1, None, None)], labels.schema)))
    assert out.columns == more.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is None or r.doc_id > 90000]
    assert sorted(map(str, ids)) == sorted(map(str, [90001, 90002, 90003, 90004, None] * 2))
    assert quality.quality_filter(more.limit(0), labels).count() == 0
    assert quality.quality_filter(docs, labels.limit(0)).count() == docs.count()


def test_toxic_held_out(spark, sf):
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, labels.where("doc_id % 2 = 0"), carry=["doc_id", "lang"]).select("r.doc_id", "r.lang", "keep")
    rows = out.join(labels.where("doc_id % 2 = 1 AND quality = 1"), "doc_id").collect()
    toxic = [r.keep for r in rows if r.toxic == 1 and r.lang == "en"]  # no other language has an insult in the tables
    assert len(toxic) > 15 and np.mean(toxic) <= 0.1
    assert np.mean([r.keep for r in rows if r.toxic == 0]) >= 0.97


def test_worst_span():
    values, offsets = np.array([1.0, -5, 2, 3, -1, 4, 4]), np.array([0, 3, 3, 6, 7])
    assert quality.worst_span(values, offsets, 2).tolist() == [1, 0, 3, 4]


def test_threshold_ignores_the_share_of_junk(spark, sf):
    larger = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.where("quality = 1 AND toxic = 0")
    docs = docs.where("lang = 'en'").select("doc_id", F.substring("text", 1, 1500).alias("text"), "lang")
    clean = docs.join(good, "doc_id", "left_semi")
    n, limits = clean.count(), []
    for share in (0.1, 0.3, 0.6):
        junk = round(n * share / (1 - share))
        bad = spark.range(junk).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit("zq### x%%% "), F.repeat(F.concat(F.hex(F.xxhash64("id")), F.lit("$$$ ")), 30)).alias("text"), F.lit("en").alias("lang"))
        rows = quality.judged(clean.unionByName(bad), good, carry=["doc_id"]).select("r.doc_id", "threshold", "keep").collect()
        limits.append(rows[0].threshold)
        assert np.mean([r.keep for r in rows if r.doc_id >= 10**6]) <= 0.05
        assert np.mean([r.keep for r in rows if r.doc_id < 10**6]) >= 0.97
    assert max(limits) - min(limits) < 1e-9
