"""Files, configuration, stages, checkpoints, command line, registry, backends and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.backends.embeddings import create_embedding, find_similar
from tidemark.backends.llms import FallbackLLM, LLMBackend, create_llm, get_llm
from tidemark.cli import main
from tidemark.frame import Samples
from tidemark.operators.dedup import ExactDedup
from tidemark.operators.filters import QualityFilter
from tidemark.plans.config import PipelineConfig, expand, load_config, merge, save_config
from tidemark.plans.pipeline import Pipeline, Tidemark
from tidemark.plans.stages import CurateStage, Stage, get_stage_class
from tidemark.registry import registry
from tidemark.sources import files
from tidemark.streaming import streams

ROWS = [{"id": f"r{i}", "instruction": f"Explain number {i // 2} please?", "output": f"The number {i} follows {i - 1} and comes before {i + 1}.", "category": "factual", "metadata": {"k": i}} for i in range(8)]


@pytest.fixture(scope="module")
def rows(spark):
    return Samples.from_list(spark, ROWS)


def test_files(spark, rows, tmp_path):
    for name in ("a.jsonl", "b.parquet", "c.json"):
        path = str(tmp_path / name)
        files.write_data(QualityFilter(0)(rows), path)
        back = files.read_data(spark, path)
        got = back.to_list()
        assert [r["id"] for r in got] == [r["id"] for r in ROWS] and [r["output"] for r in got] == [r["output"] for r in ROWS]
        assert got[0]["meta"]["quality_score"] == pytest.approx(0.96)  # nine words: repetition counts 0.8
    with open(tmp_path / "d.jsonl", "w") as f:
        f.write('{"instruction": "é", "extra": 1}\n\n{"id": 5, "output": "x"}\n')
    got = files.read_data(spark, str(tmp_path / "d.jsonl")).to_list()
    assert [(r["instruction"], r["output"]) for r in got] == [("é", ""), ("", "x")] and got[1]["id"] == "5"
    with open(tmp_path / "e.csv", "w") as f:
        f.write('id,instruction,output\n1,"a\nb","say ""x"""\n')
    assert files.read_data(spark, str(tmp_path / "e.csv")).to_list()[0]["output"] == 'say "x"'
    with open(tmp_path / "bad.jsonl", "w") as f:
        f.write("{nonsense\n")
    with pytest.raises(Exception):
        files.read_data(spark, str(tmp_path / "bad.jsonl")).to_list()
    for wrong in ("x.txt", "x.csv"):
        with pytest.raises(ValueError):
            files.write_data(rows, str(tmp_path / wrong))
    with pytest.raises(ValueError):
        files.read_data(spark, "x.txt")


def test_fine_tuning_files(spark, rows, tmp_path):
    path = str(tmp_path / "out" / "set.json")
    assert files.write_sft(rows.df, path) == 8
    with open(path) as f:
        data = json.load(f)
    assert data[3] == {"instruction": ROWS[3]["instruction"], "input": "", "output": ROWS[3]["output"]}
    files.write_registry(["set"], str(tmp_path / "info.json"))
    with open(tmp_path / "info.json") as f:
        assert json.load(f)["set"]["columns"]["prompt"] == "instruction"
    with open(tmp_path / "qa.jsonl", "w") as f:
        f.writelines(json.dumps({"question": f" 什么是 {i} ", "answer": "x"}) + "\n" for i in range(5))
    qa = files.load_raw(spark, str(tmp_path / "qa.jsonl"), limit=3)
    got = files.convert_qa(qa).orderBy("_ord").collect()
    assert [r.id for r in got] == ["baike_000000", "baike_000001", "baike_000002"] and got[0].instruction == "什么是 0" and got[0].category == "factual"
    assert files.set_statistics(spark.read.json(path, multiLine=True)).first().n == 8


CONFIG = {
    "name": "demo", "stages": [
        {"name": "s1_data_juicer", "operators": [{"name": "exact_dedup", "params": {"field": "instruction"}}, {"name": "quality_filter", "params": {"threshold": 0.7}}, {"name": "noise_detector", "enabled": False}]},
        {"name": "s2_knowledge_filter", "operators": [{"name": "knowledge_filter", "params": {"top_k": 3}}]},
        {"name": "s4_sandbox_eval", "operators": [], "report_path": "$REPORTS/r.html", "metrics_path": "$REPORTS/m.json"},
    ],
}


def test_pipeline(spark, rows, tmp_path, monkeypatch):
    import yaml

    monkeypatch.setenv("REPORTS", str(tmp_path / "rep"))
    conf = CONFIG | {"checkpoint_dir": str(tmp_path / "ck")}
    path = str(tmp_path / "c.yaml")
    with open(path, "w") as f:
        yaml.safe_dump(conf, f)
    app = Tidemark(spark, path)
    result = app.run_pipeline(rows)
    assert [(s["in"], s["out"]) for s in result.stages] == [(8, 4), (4, 3), (3, 3)] and len(result.data) == 3
    m = result.metrics["s1_data_juicer"]
    assert m["op_0_exact_dedup"]["removed_count"] == 4 and m["op_1_quality_filter"]["output_count"] == 4
    with open(tmp_path / "rep" / "m.json") as f:
        assert json.load(f)["total"] == 3
    assert "s1_data_juicer" in result.report()
    result.save(str(tmp_path / "res.json"))
    again = app.run_pipeline(rows, resume_from="s1_data_juicer")
    assert [s["stage"] for s in again.stages] == ["s2_knowledge_filter", "s4_sandbox_eval"]
    with pytest.raises(ValueError):
        app.run_pipeline(rows, resume_from="unknown")
    assert app.pipeline.status()["checkpoints"] == ["s1_data_juicer", "s2_knowledge_filter", "s4_sandbox_eval"]
    with pytest.raises(ValueError):
        Pipeline(stages=[Stage([QualityFilter(1.01)])]).run(rows)
    assert len(app.run_stage("s2_knowledge_filter", rows)) == 3
    data = str(tmp_path / "in.parquet")
    files.write_data(rows, data)
    assert main(["run", "-c", path, "-i", data, "-o", str(tmp_path / "o.parquet")]) == 0
    assert main(["run-stage", "s2_knowledge_filter", "-c", path, "-i", data]) == 0
    assert main(["evaluate", "-i", data, "-r", str(tmp_path / "ev")]) == 0 and os.path.exists(tmp_path / "ev" / "quality_report.html")
    assert main(["validate-config", path]) == 0 and main(["validate-config", data]) == 1
    assert main(["status", "-d", str(tmp_path / "ck")]) == 0 and main(["clear-checkpoints", "-y", "-d", str(tmp_path / "ck")]) == 0
    assert app.pipeline.checkpointer.list_checkpoints() == []


def test_default_shapes_build():
    names = ["exact_dedup", "semantic_dedup", "quality_filter", "diversity_filter", "knowledge_filter", "llm_synthesis", "reasoning_chain", "noise_detector"]
    assert set(names) <= set(registry.list("operators"))
    stages = [{"name": s, "operators": [{"name": n} for n in names]} for s in ("s1_data_juicer", "data_juicer", "s2_knowledge_filter", "s3_reasoning_enhance", "s4_sandbox_eval")]
    p = Pipeline(PipelineConfig.of({"stages": stages, "llm": {"backend": "echo"}, "checkpoint_enabled": False}))
    assert len(p.stages) == 5 and len(p.stages[0].operators) == 8 and p.stages[4].operators == []
    assert [o.name for o in CurateStage().operators] == names[:4]
    assert [o.name for o in get_stage_class("knowledge_filter")().operators] == ["knowledge_filter", "llm_synthesis", "knowledge_filter"]
    with pytest.raises(KeyError):
        Pipeline(PipelineConfig.of({"stages": [{"name": "s1_data_juicer", "operators": [{"name": "nothing"}]}]}))
    with pytest.raises(KeyError):
        get_stage_class("nothing")


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("X_Y", "z")
    assert expand({"a": ["$X_Y", 1, {"b": "${X_Y}!"}]}) == {"a": ["z", 1, {"b": "z!"}]}
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    for bad in ({"dedup_threshold": 2}, {"target_samples": 0}, {"llm": {"temperature": 3}}, {"embedding": {"batch_size": 0}}, {"input_format": "xml"}, {"stages": [{"name": "s", "top_k": 0}]}):
        with pytest.raises(ValueError):
            PipelineConfig.of(bad)
    c = PipelineConfig.of(CONFIG | {"own": 1})
    for name in ("c.json", "d.yaml"):
        save_config(c, str(tmp_path / name))
        assert load_config(str(tmp_path / name)).dump() == c.dump()
    with pytest.raises(ValueError):
        save_config(c, str(tmp_path / "c.toml"))
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yaml"))


def test_registry_and_backends(spark):
    with pytest.raises(KeyError, match="exact_dedup"):
        registry.get("operators", "nothing")
    assert isinstance(registry.create("operators", "exact_dedup", field="output"), ExactDedup)
    assert {"hashing", "st", "hf", "openai"} <= set(registry.list("embeddings")) and {"echo", "ollama", "openai"} <= set(registry.list("llms"))
    e = create_embedding("hashing", dimension=32)
    assert e.embed_batched(["a", "b", "c"], 2).shape == (3, 32) and e.similarity("one text", "one text") == pytest.approx(1, abs=1e-6) and e.health_check()
    llm = create_llm("echo")
    assert llm.generate("x\ny").text == "y" and llm.chat([{"role": "user", "content": "hi"}]).text == "Assistant:" and list(llm.stream("q")) == ["q"]
    import asyncio

    assert asyncio.run(llm.abatch_generate(["a", "b"]))[1].text == "b"

    class Broken(LLMBackend):
        def generate(self, prompt, **options):
            raise RuntimeError("down")

    both = FallbackLLM(Broken(), llm)
    assert both.generate("z").text == "z" and both.health_check() and not Broken().health_check()
    assert isinstance(get_llm("ollama", fallback="echo"), FallbackLLM)
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.match for r in find_similar(v.where("vec_id = 0"), v, 1).collect()] == [1]


def test_plan_text(rows):
    text = QualityFilter().explain(rows.df)
    assert "QualityFilter" in text or "quality_filter" in text
    assert "EvalPython" not in text and "MapIn" not in text


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [{"id": str(i), "instruction": f"Explain {i % 3} to me?", "output": "word " * 3 if i % 4 == 0 else f"A long enough answer with number {i}.", "category": "c", "ts": f"2026-01-01 00:00:0{i}"} for i in range(8)]
    os.makedirs(path)
    with open(path + "/a.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    got = streams.run_once(streams.curate(streams.read_stream(spark, path), threshold=0.8, dedup="instruction"), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = {r.instruction for r in got.collect()}
    assert len(out) == got.count() <= 3
    assert got.where(F.col("quality_score") < 0.8).count() == 0


def test_checkpoints_on_a_named_file_system(spark, tmp_path, monkeypatch):
    from tidemark.frame import Samples
    from tidemark.plans.pipeline import Checkpointer

    monkeypatch.chdir(tmp_path)
    c = Checkpointer(f"file://{tmp_path}/deep/checks")
    assert c.list_checkpoints() == [] and not c.exists("one")
    c.save("one", Samples.from_list(spark, [{"instruction": "é"}]))
    assert c.exists("one") and c.list_checkpoints() == ["one"] and c.facts("one")["sample_count"] == 1
    assert c.load(spark, "one").to_list()[0]["instruction"] == "é" and not (tmp_path / "file:").exists()
    c.clear()
    assert c.list_checkpoints() == [] and not (tmp_path / "deep/checks/one.parquet").exists()
