"""Golden values of fourteen rows that reach every rule, and of the container, files and configuration."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.frame import Samples
from tidemark.functions import scores
from tidemark.functions.text import normalized, strip, words
from tidemark.operators.dedup import ExactDedup, SemanticDedup, TfidfDedup, block_pairs, greedy_drop, lsh_pairs
from tidemark.operators.diversity import DiversityFilter, diversity_score, farthest_first, kmeans, maxmin
from tidemark.operators.enrich import LLMSynthesis, ReasoningChainEnhancer
from tidemark.operators.filters import KnowledgeFilter, LengthFilter, NoiseDetector, PrefixAdder, QualityFilter
from tidemark.plans import evaluation
from tidemark.schema import set_meta

ROWS = [
    ("f01", "How do tides form around the coast?", "Tides form because the Moon pulls on the ocean water as the Earth turns each day.", "factual", 1.0, 0.454612183, None, "keep", False),
    ("f02", "how  do TIDES form around the\tcoast? ", "Gravity.", "factual", 0.82, 0.461, "output_too_short", "drop", False),
    ("f03", "Hey", "ok", "daily", 0.62, 0.375666667, "instruction_too_short", "drop", False),
    ("f04", "Describe a quiet harbour at dawn", "blue " * 24 + "boat", "creative", 0.824, 0.185877669, "highly_repetitive", "drop", False),
    ("f05", "Is the shop open now?", "Maybe later", "daily", 0.82, 0.453973122, "possible_incomplete_answer", "flag", False),
    ("f06", "Give me the access code please", "Sorry, but I cannot share it with anybody here today.", "other", 0.8, 0.517666667, "contains_refusal", "flag", False),
    ("f07", "Tell me about review", "As an AI language model I have opinions on many subjects and topics.", "other", 0.84, 0.526310952, "contains_refusal", "flag", False),
    ("f08", "List the steps to sum 12 and 30", "Step 1: add 12 and 30. Step 2: the total is 42.", "reasoning", 1.0, 0.445747004, None, "keep", False),
    ("f09", "What is 12 plus 30 minus 2.5?", "It equals 39.5 because 12 plus 30 is 42.", "reasoning", 0.96, 0.409166667, None, "keep", True),
    ("f10", "Why > what?", "... " * 6 + "=== " * 5 + "done", "reasoning", 0.875, 0.236788732, "possible_incomplete_answer", "flag", True),
    ("f11", "Name one bird", "word " * 11, "daily", 0.767272727, 0.158956015, None, "keep", False),
    ("f12", "N" * 2001 + "?", "A fairly ordinary sentence about nothing in particular.", "other", 0.86, 0.483746875, None, "keep", False),
    ("f13", "Summarise the report for the board", "r" * 8001, "other", 0.8, 0.724115979, None, "keep", False),
    ("f14", "", "", "other", 0.62, 0.0, "instruction_too_short", "drop", False),
]


@pytest.fixture(scope="module")
def golden(spark):
    return Samples.from_list(spark, [dict(zip(("id", "instruction", "output", "category"), r)) for r in ROWS])


def ids(samples):
    return [r["id"] for r in samples]


def test_quality(golden):
    for t, n in ((0.6, 14), (0.7, 12), (0.8, 11)):
        op = QualityFilter(t)
        out = op(golden)
        assert len(out) == n
        m = op.metrics
        assert (m["input_count"], m["output_count"]) == (14, n) and m["avg_score"] == pytest.approx(0.829019481, abs=1e-8)
        assert (m["min_score"], m["max_score"]) == (pytest.approx(0.62), pytest.approx(1.0))
    got = {r["id"]: r["meta"]["quality_score"] for r in QualityFilter(0)(golden)}
    assert all(got[r[0]] == pytest.approx(r[4], abs=1e-8) for r in ROWS)


def test_exact_dedup(golden):
    op = ExactDedup()
    assert ids(op(golden)) == [r[0] for r in ROWS if r[0] != "f02"]
    assert op.metrics["removed_count"] == 1
    g = op.find_duplicates(golden.df).collect()
    assert [(r.key, r.positions) for r in g] == [("e2ae2c6455f9291d655b35b02d131d47", [0, 1])]
    for other in (ExactDedup("output"), ExactDedup("both"), ExactDedup("all"), ExactDedup(normalize=False)):
        assert len(other(golden)) == 14
    once = op(golden)
    assert ids(op(once)) == ids(once)


def test_noise(golden):
    op = NoiseDetector()
    out = {r["id"]: r["meta"] for r in op(golden)}
    assert set(out) == {r[0] for r in ROWS if r[7] != "drop"}
    for r in ROWS:
        if r[0] in out:
            assert out[r[0]]["noise_detection"]["reason"] == (r[6] or "no_issues")
            assert bool(out[r[0]]["flagged"]) == (r[7] == "flag")
    both = out["f10"]["noise_detection"]["all_issues"]
    assert [x["reason"] for x in both] == ["possible_incomplete_answer", "excessive_artifacts"]
    assert op.metrics["removed_count"] == 4 and op.metrics["flagged_count"] == 4
    assert len(NoiseDetector(action_error="merge")(golden)) == 14


def test_knowledge(golden):
    op = KnowledgeFilter(top_k=4)
    out = op(golden)
    assert ids(out) == ["f13", "f07", "f06", "f12"]
    m = op.metrics
    assert m["avg_score"] == pytest.approx(0.388116324, abs=1e-8) and m["min_kept_score"] == pytest.approx(0.483746875, abs=1e-8)
    got = {r["id"]: r["meta"]["knowledge_score"] for r in KnowledgeFilter(top_k=99)(golden)}
    assert all(got[r[0]] == pytest.approx(r[5], abs=1e-8) for r in ROWS)
    assert ids(KnowledgeFilter(min_score=0.5)(golden)) == ["f13", "f07", "f06"]
    near = KnowledgeFilter(top_k=3)
    near.set_reference_corpus([ROWS[7][1] + " " + ROWS[7][2]])
    assert ids(near(golden))[0] in ("f08", "f13")


def test_dataset_metrics(golden):
    m = evaluation.metrics_dict(QualityFilter(0.7)(golden).df)
    assert m["total"] == 12 and m["quality_mean"] == pytest.approx(0.863856061, abs=1e-8)
    assert m["categories"] == {"factual": 2, "creative": 1, "daily": 2, "other": 4, "reasoning": 3}
    assert (m["instruction_length_mean"], m["instruction_length_min"], m["instruction_length_max"]) == (191.25, 11, 2002)
    assert m["output_length_mean"] == pytest.approx(715.916666667) and m["knowledge_mean"] == 0.5


def test_predicates(spark, golden):
    got = {r["id"]: r for r in golden.df.select("id", ReasoningChainEnhancer("echo").wanted().alias("w")).collect()}
    assert all(got[r[0]].w == r[8] for r in ROWS)
    pairs = [("1 2 3", "1 2", True), ("1 2 3", "1", False), ("no digits", "", True), ("３", "3", False), ("2.5", "is 2.5.", True), ("1 2", "2 9", True)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", scores.keeps_numbers(F.col("a"), F.col("b"))).collect())
    qs = [("什么是光合作用？", "factual", "factual"), ("为什么天空是蓝的", "factual", "reasoning"), ("如何写一首诗", "creative", "reasoning"), ("你好", "daily", "daily"), ("", "daily", "daily")]
    df = spark.createDataFrame(qs, "q string, a string, b string")
    for r in df.select("a", "b", scores.category_by_count(F.col("q")).alias("x"), scores.category_by_first(F.col("q")).alias("y")).collect():
        assert (r.x, r.y) == (r.a, r.b)
    ks = [("什么是光合作用？", "光合作用是植物利用阳光的过程，发现于1779年。", 0.66962963), ("如何泡茶", "先烧水", 0.571666667), ("hello", "", 0.166666667)]
    df = spark.createDataFrame(ks, "i string, o string, k double")
    assert all(r.k == pytest.approx(r.g, abs=1e-8) for r in df.select("k", scores.offline_knowledge_score(F.col("i"), F.col("o")).alias("g")).collect())


def test_white_space(spark):
    odd = "".join(map(chr, [9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    texts = ["", " ", "a", *(f"{c}X{c}y{c}{c}z" for c in odd), "no​break", "ΟΔΟΣ x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", words(F.col("t")).alias("w"), strip(F.col("t")).alias("s"), normalized(F.col("t")).alias("n")).collect():
        assert r.w == r.t.split() and r.s == r.t.strip() and r.n == " ".join(r.t.lower().split())


def test_container(spark, golden, tmp_path):
    assert len(golden) == 14 and golden[0]["id"] == "f01" and golden[-1]["id"] == "f14"
    assert ids(golden.head(2)) == ["f01", "f02"] and ids(golden.tail(2)) == ["f13", "f14"] and len(golden.tail(0)) == 0
    assert ids(golden[3:5]) == ["f04", "f05"] and len(golden.sample(5)) == 5 and len(golden.sample(99)) == 14
    assert ids(golden.sample(5, 1)) == ids(golden.sample(5, 1))
    twice = golden.concat(golden)
    assert len(twice) == 28 and ids(twice)[14:] == ids(golden)
    assert ids(golden.diff(golden.head(12))) == ["f13", "f14"]
    assert len(golden.filter(F.col("category") == "daily")) == 3 and len(golden.filter(lambda r: r["category"] == "daily")) == 3
    assert golden.map({"output": F.upper("output")})[2]["output"] == "OK"
    assert golden.map(lambda r: r | {"output": "x"})[2]["output"] == "x"
    d = golden.describe()
    assert d["count"] == 14 and d["categories"]["other"] == 5 and d["output_length"]["max"] == 8001
    assert Samples.from_list(spark, []).describe() == {"count": 0}
    with pytest.raises(IndexError):
        golden[99]
    with pytest.raises(ValueError):
        golden.to_list(3)
    assert sum(x["n"] for x in golden.plot_distribution("output")) == 14 and "<table>" in golden._repr_html_()

    class Longest:
        name = "longest"

        def aggregate(self):
            return F.max(F.length("output"))

    class Rows:
        name = "rows"

        def compute(self, samples):
            return len(samples)

    assert golden.compute_metrics([Longest(), Rows()]) == {"longest": 8001, "rows": 14} == golden.metrics
    assert len(LengthFilter()(golden)) == len([r for r in ROWS if 50 <= len(r[2]) <= 5000])
    assert PrefixAdder(">")(golden)[2]["output"] == ">ok"


def test_defaults_and_nulls(spark):
    s = Samples.from_list(spark, [{"instruction": "a"}, {"instruction": None, "output": None, "category": None, "id": 7}])
    a, b = s.to_list()
    assert a["output"] == "" and a["category"] == "other" and a["id"] and b["id"] == "7" and b["instruction"] == ""
    for op in (ExactDedup(), QualityFilter(), NoiseDetector(), KnowledgeFilter(2)):
        op(s).to_list()
        assert op(Samples.from_list(spark, [])).to_list() == []


def test_similarity(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.standard_normal((120, 16))
    v[60:] = v[:60] + 0.2 * rng.standard_normal((60, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "_ord long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if round(u[i] @ u[j], 9) >= 0.6}
    assert {(r.i, r.j) for r in block_pairs(df, 0.6).collect()} == want
    found = {(r.i, r.j) for r in lsh_pairs(df, 0.9, 16).collect()}
    close = {(i, j) for i, j in want if u[i] @ u[j] >= 0.9}
    assert found <= close and len(found) >= 0.9 * len(close)
    gone: set = set()
    for i in range(120):
        if i not in gone:
            gone |= {j for a, j in want if a == i}
    pairs = block_pairs(df, 0.6)
    assert {r._ord for r in greedy_drop(pairs).collect()} == gone == {r._ord for r in greedy_drop(pairs, small=0).collect()}
    picked = [r._ord for r in maxmin(df, 10).orderBy("rank").collect()]
    assert picked == farthest_first(v, 10)
    for pool in (1, 7, 60):
        assert [r._ord for r in maxmin(df, 10, pool).orderBy("rank").collect()] == picked
    assert maxmin(df.limit(0), 5).collect() == [] and maxmin(df, 10_000).count() == len(v)
    assert diversity_score(df).first()[0] == pytest.approx(1 - np.mean((u @ u.T)[np.triu_indices(120, 1)]), abs=1e-6)
    assert diversity_score(df.limit(1)).first()[0] == 1.0 == diversity_score(df.limit(0)).first()[0]
    assert 1 <= kmeans(df, 5).count() <= 5


def test_near_texts(spark):
    rows = [{"id": str(i), "instruction": t, "output": "o"} for i, t in enumerate(["how do tides form", "how do tides form?", "name a bird", "how do tides form"])]
    s = Samples.from_list(spark, rows)
    assert ids(SemanticDedup(0.9)(s)) == ["0", "2"]
    more = Samples.from_list(spark, [{"id": str(i), "instruction": t} for i, t in enumerate(["abcabc", "xyz", "cabcab", "qrs", "xyw", "mno", "mnp", "qrt"])])
    op = TfidfDedup(0.99)
    assert ids(op(more)) == ["0", "1", "3", "5"]  # a letter of one text only is no token: xyz and xyw are alike
    assert op.metrics["threshold"] == 0.99
    d = DiversityFilter(2)
    assert len(d(s)) == 2 and d.metrics["output_count"] == 2
    assert len(DiversityFilter(9)(s)) == 4 and len(DiversityFilter(2, "random")(s)) == 2 and len(DiversityFilter(2, "kmeans")(s)) <= 2


def test_enrichment(spark, golden):
    low = Samples(set_meta(golden.df, quality_score=QualityFilter().score()))
    op = LLMSynthesis("echo", quality_threshold=0.7, synthesis_style="nonsense")
    out = {r["id"]: r for r in op(low)}
    assert len(out) == 14 and {k for k, r in out.items() if r["meta"]["synthesized"]} == {"f03", "f14"}
    assert out["f03"]["output"] == "Answer: ok" and out["f03"]["meta"]["original_output"] == "ok"
    assert op.metrics["synthesized_count"] == 2
    op = ReasoningChainEnhancer("echo")
    out = {r["id"]: r for r in op(golden)}
    assert out["f09"]["meta"]["reasoning_verification_failed"] is None or out["f09"]["output"] == ROWS[8][2]
    assert out["f01"]["output"] == ROWS[0][2] and op.metrics["input_count"] == 14
    broken = {r["id"]: r for r in LLMSynthesis("ollama", target_samples="all", base_url="http://127.0.0.1:9")(golden.head(2))}
    assert broken["f01"]["output"] == ROWS[0][2] and broken["f01"]["meta"]["synthesis_error"]


def test_human_evaluation(spark):
    q = spark.createDataFrame([(1, "q1"), (2, "q2")], "question_id long, instruction string")
    a = spark.createDataFrame([(1, "m1", "x"), (1, "m2", "y"), (2, "m1", None)], "question_id long, model string, content string")
    sheet = evaluation.blind_sheet(q, a)
    assert {r.question_id: len(r.responses) for r in sheet.collect()} == {1: 2, 2: 1}
    assert {r.model: r.score for r in evaluation.human_scores(sheet).collect()} == {"m1": None, "m2": None}
    raw = spark.createDataFrame([(json.dumps({"results": {"ceval,none": {"acc": 0.5}, "cmmlu": {"acc_norm": 0.25, "alias": "x"}, "z": {"f1": 1}}}),)], "value string")
    assert {r.task: r.score for r in evaluation.task_results(raw).collect()} == {"ceval": 50.0, "cmmlu": 25.0}
    assert "50.0%" in evaluation.comparison_table({"baseline_10k": {"ceval": 40.0}, "m": {"ceval": 20.0}})
