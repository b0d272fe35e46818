"""The pipeline's stages, each against a plain definition on the stage's own input."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_lines_and_minhash import shingle_set
from tests.llm.test_output import brute_passages, one_by_one
from tidemark.llm import decontaminate, line_dedup, quality
from tidemark.llm.common import written
from tidemark.llm.tokens import Tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(name, input, output) of each stage; the documents have odd rows besides their own."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("n_chars > 600").orderBy("doc_id").first().text
    w = text.split(" ")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [
        (70001, text, "fr", "s", 1), (70002, " ".join([*w[:40], "autre", *w[41:]]), "fr", "s", 1), (70003, None, "en", "s", None), (70004, "", "en", None, 0),
        (None, "The and to of.", "en", "s", 14), (70005, f"Was it so? {item.upper()} It was.", None, "s", 1), (70006, "x", "en", "s", 1), (70006, "x", "en", "s", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        made.append((name, docs, out))
        docs = out
    return made


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, *_ in stages] and 4 <= len(stages) <= 5
    for _, before, after in stages[:-1]:
        assert after.columns == COLUMNS and after.dtypes == before.dtypes
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_quality_stage(spark, sf, stages):
    _, before, after = stages[0]
    judged = quality.judged(before, spark.read.parquet(f"{sf}/labels.parquet"), carry=["doc_id"]).select("r.doc_id", "keep").collect()
    assert sorted(str(r.doc_id) for r in judged if r.keep) == sorted(str(r.doc_id) for r in after.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [i in kept for i, q in labels.items() if q == 1]  # each judged by a model that didn't count it
    assert sum(good) >= 0.95 * len(good)
    poor = [i in kept for i, q in labels.items() if q == 0]
    assert sum(poor) <= 0.3 * len(poor)


def test_line_stage(stages):
    _, before, after = stages[1]
    rows = before.collect()
    normal = lambda s: " ".join(s.lower().split())
    docs_of = {}
    for t in {r.text for r in rows if r.text is not None}:
        for s in {normal(s) for s in t.split("\n")} - {""}:
            docs_of[s] = docs_of.get(s, 0) + 1
    cut = lambda t: None if t is None else "\n".join(s for s in t.split("\n") if docs_of.get(normal(s), 0) <= line_dedup.MAX_DOCS)
    want = sorted(str((r.doc_id, cut(r.text), None if r.text is None else len(cut(r.text)))) for r in rows)
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in after.collect()) == want


def test_near_stage(stages):
    _, before, after = stages[2]
    rows = {r.doc_id: r.text for r in before.collect() if r.doc_id is not None and r.text}
    kept = [r.doc_id for r in after.collect()]
    sets = {i: shingle_set(t) for i, t in rows.items()}
    sets = {i: s for i, s in sets.items() if s}
    ids = sorted(sets)
    close = {i: set() for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= 0.65:
                close[a].add(b)
                close[b].add(a)
    gone = set(ids) - set(kept)
    pairs = [(a, b) for a in ids for b in close[a] if a < b]
    assert pairs and sum(a in gone or b in gone for a, b in pairs) >= 0.95 * len(pairs)
    for a in gone:  # whoever goes has a near copy
        assert max(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in ids if b != a) > 0.35
    assert kept.count(None) == 1 and 70003 in kept and 70004 in kept


def test_benchmark_stage(spark, sf, stages):
    _, before, after = stages[3]
    rows = before.collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r for r, *_ in brute_passages([r.text for r in rows], items)}
    assert hit and sorted(str(r.doc_id) for k, r in enumerate(rows) if k not in hit) == sorted(str(r.doc_id) for r in after.collect())
    assert decontaminate.NGRAM == 8 and 70005 not in {r.doc_id for r in after.collect()}


def test_packing_stage(spark, stages):
    _, before, after = stages[4]
    encode, lengths = Tokens(spark).encoding().encode_ordinary, []
    for r in before.collect():
        n = len(encode(r.text or ""))
        lengths += [2048] * (n // 2048) + ([n % 2048] if n % 2048 else [])
    bins = {}
    for r in after.collect():
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert sorted(tuple(sorted(b, reverse=True)) for b in bins.values()) == one_by_one(lengths, 2048)


def test_run(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"bin_id", "doc_id", "n_tokens"} <= set(out[0].asDict())
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / "none" / f"{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
