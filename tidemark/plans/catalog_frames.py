"""Named queries over frames, files, stages and configurations, each with its SQL; ``catalog`` holds the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import Samples
from tidemark.functions import scores
from tidemark.operators.dedup import ExactDedup, SemanticDedup
from tidemark.operators.diversity import DiversityFilter
from tidemark.operators.enrich import LLMSynthesis, ReasoningChainEnhancer
from tidemark.operators.filters import NoiseDetector, QualityFilter
from tidemark.plans import evaluation
from tidemark.plans.catalog import _NUM, _RULES, DOCS, PAIRS, QUALITY, SCORED, _any, _norm, _strip, documents, pairs, query, r6
from tidemark.plans.config import PipelineConfig
from tidemark.plans.pipeline import Pipeline
from tidemark.plans.stages import CurateStage, KnowledgeStage, ReasoningStage
from tidemark.plans.storage import new_path
from tidemark.registry import registry
from tidemark.schema import set_meta
from tidemark.sources.files import dataset_registry, load_raw, read_data, set_statistics, write_data

TEXTS = ("id", "instruction", "input", "output", "category")
ALL = f"WITH {PAIRS} SELECT id, instruction, '' AS input, output, category, ord FROM s"


def _texts(samples: Samples) -> DataFrame:
    return samples.df.select(*TEXTS, F.col("_ord").alias("ord"))


# -- files --


def _round_trip(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    path = new_path(spark, "samples") + suffix
    write_data(Samples(pairs(spark, d)), path)
    return read_data(spark, path).df


@query(f"WITH {PAIRS} SELECT id, instruction, '' AS input, output, category, row_number() OVER (ORDER BY ord) - 1 AS ord FROM s")
def jsonl_round_trip(spark, d):
    return _texts(Samples(_round_trip(spark, d, ".jsonl")))


@query(ALL)
def parquet_round_trip(spark, d):
    return _texts(Samples(_round_trip(spark, d, ".parquet")))


@query(f"WITH {PAIRS} SELECT id, instruction, output, category FROM s")
def csv_read(spark, d):
    path = new_path(spark, "samples") + ".csv"
    pairs(spark, d).select("id", "instruction", "output", "category").write.option("escape", '"').csv(path, header=True)
    return read_data(spark, path).df.select("id", "instruction", "output", "category")


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS k FROM s) SELECT instruction AS question, output AS answer, k AS ord FROM k WHERE k < 60")
def load_raw_first(spark, d):
    path = new_path(spark, "raw")
    pairs(spark, d).select(F.col("instruction").alias("question"), F.col("output").alias("answer"), "_ord").repartition(1).sortWithinPartitions("_ord").drop("_ord").write.json(path)
    return load_raw(spark, path, 60).select("question", "answer", F.col("_ord").alias("ord"))


@query(f"WITH {PAIRS} SELECT id, instruction, output, category FROM s ORDER BY ord LIMIT 40")
def list_round_trip(spark, d):
    rows = Samples(pairs(spark, d)).head(40).to_list()
    return Samples.from_list(spark, rows).df.select("id", "instruction", "output", "category")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, '' AS instruction, text AS output, 'other' AS category FROM documents")
def from_dataframe(spark, d):
    """Columns that a frame lacks take their defaults, others are dropped."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("output"), "lang")
    return Samples.from_dataframe(t).df.select("id", "instruction", "output", "category")


@query(f"WITH {DOCS} SELECT 'documents' AS file, count(*) AS n, round(avg(length(instruction)), 6) AS mean_instruction, round(avg(length(output)), 6) AS mean_output FROM s")
def file_statistics(spark, d):
    found = set_statistics(documents(spark, d))  # a table may be several files
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    named = found.withColumn("file", F.regexp_extract("file", r"(\w+)\.parquet", 1))
    return named.groupBy("file").agg(F.sum("n").alias("n"), r6(w("mean_instruction")).alias("mean_instruction"), r6(w("mean_output")).alias("mean_output"))


@query("SELECT * FROM (VALUES ('small', 'small.json', 'instruction', 'input', 'output'), ('large', 'large.json', 'instruction', 'input', 'output')) t(name, file_name, prompt, query, response)")
def training_registry(spark, d):
    rows = [(k, v["file_name"], *(v["columns"][c] for c in ("prompt", "query", "response"))) for k, v in dataset_registry(["small", "large"]).items()]
    return spark.createDataFrame(rows, "name string, file_name string, prompt string, query string, response string")


# -- frames --


@query(f"WITH {DOCS} SELECT id FROM s WHERE length(output) > 500 AND category <> 'web'")
def filter_column(spark, d):
    return Samples(documents(spark, d)).filter((F.length("output") > 500) & (F.col("category") != "web")).df.select("id")


@query(f"WITH {DOCS} SELECT id FROM s WHERE length(output) % 3 = 0")
def filter_function(spark, d):
    return Samples(documents(spark, d)).filter(lambda r: len(r["output"]) % 3 == 0).df.select("id")


@query(f"WITH {DOCS} SELECT id, instruction || '!' AS instruction, category FROM s")
def map_columns(spark, d):
    return Samples(documents(spark, d)).map({"instruction": F.concat("instruction", F.lit("!"))}).df.select("id", "instruction", "category")


@query(f"WITH {PAIRS} SELECT id, instruction, substr(output, 1, 20) AS output FROM s")
def map_function(spark, d):
    return Samples(pairs(spark, d)).map(lambda r: r | {"output": r["output"][:20]}).df.select("id", "instruction", "output")


@query(f"WITH {DOCS} SELECT id FROM s ORDER BY ord LIMIT 30 OFFSET 20")
def slice_rows(spark, d):
    return Samples(documents(spark, d))[20:50].df.select("id")


@query(f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (ORDER BY ord) AS k, count(*) OVER () AS n FROM s) SELECT id, n FROM n WHERE k = 8 OR k = n")
def rows_by_position(spark, d):
    s = Samples(pairs(spark, d))
    return spark.createDataFrame([(s[k]["id"], len(s)) for k in (7, -1)], "id string, n long")


@query(f"WITH {DOCS} SELECT max(length(output)) AS longest, count(DISTINCT category) AS categories FROM s")
def frame_metrics(spark, d):
    class Longest:
        name = "longest"

        def aggregate(self):
            return F.max(F.length("output").cast("long"))

    class Categories:
        name = "categories"

        def compute(self, samples):
            return samples.df.select("category").distinct().count()

    m = Samples(documents(spark, d)).compute_metrics([Longest(), Categories()])
    return spark.createDataFrame([(m["longest"], m["categories"])], "longest long, categories long")


@query(f"WITH {PAIRS}, t AS (SELECT * FROM s ORDER BY ord LIMIT 20) SELECT string_agg(id || ' | ' || category || ' | ' || substr(instruction, 1, 100) || ' | ' || substr(output, 1, 100), chr(10) ORDER BY ord) AS shown FROM t")
def shown_rows(spark, d):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()):
        text = Samples(pairs(spark, d)).show()
    return spark.createDataFrame([(text,)], "shown string")


@query(
    "SELECT * FROM (VALUES ('operators', 'diversity_filter'), ('operators', 'exact_dedup'), ('operators', 'knowledge_filter'), ('operators', 'llm_synthesis'), ('operators', 'noise_detector'), ('operators', 'quality_filter'),"
    " ('operators', 'reasoning_chain'), ('operators', 'semantic_dedup'), ('llms', 'echo'), ('llms', 'ollama'), ('llms', 'openai'), ('embeddings', 'openai'), ('embeddings', 'sentence_transformers')) t(kind, name)"
)
def registered_names(spark, d):
    """What a user of the registry looks for; there are others."""
    wanted = {"operators": "diversity_filter exact_dedup knowledge_filter llm_synthesis noise_detector quality_filter reasoning_chain semantic_dedup", "llms": "echo ollama openai", "embeddings": "openai sentence_transformers"}
    import tidemark.backends.llms  # noqa: F401  registers

    return spark.createDataFrame([(k, n) for k, names in wanted.items() for n in names.split() if n in registry.list(k)], "kind string, name string")


# -- diversity --


@query(f"WITH {DOCS}, p AS (SELECT * FROM s ORDER BY md5('42:' || id), id, ord LIMIT 100) SELECT id FROM p")
def diversity_random(spark, d):
    return DiversityFilter(100, "random").apply(documents(spark, d)).select("id")


@query()
def diversity_filter(spark, d):
    """Farthest first by the hashing embedding, which SQL has not; tested against a plain loop."""
    return DiversityFilter(40).apply(pairs(spark, d)).select("id", F.col("_ord").alias("rank"))


@query()
def semantic_dedup(spark, d):
    return SemanticDedup(0.9).apply(pairs(spark, d)).select("id")


# -- evaluation --


@query("SELECT conv_id AS question_id, role AS model, min(text) AS content, CAST(count(DISTINCT role) OVER (PARTITION BY conv_id) AS INTEGER) AS n, true AS blind FROM conversations GROUP BY conv_id, role")
def blind_sheet(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    answers = c.groupBy(F.col("conv_id").alias("question_id"), F.col("role").alias("model")).agg(F.min("text").alias("content"))
    questions = c.select(F.col("conv_id").alias("question_id"), F.lit("q").alias("instruction")).distinct()
    sheet = evaluation.blind_sheet(questions, answers)
    rows = sheet.select("question_id", F.size("responses").alias("n"), F.posexplode("responses").alias("k", "r"))
    blind = (F.col("r.response_id") == F.char(F.col("k") + 65)) & F.forall(F.map_values("r.scores"), lambda x: x.isNull())
    return rows.select("question_id", F.col("r._model").alias("model"), F.col("r.content").alias("content"), "n", blind.alias("blind"))


@query("SELECT lang || CAST(doc_id AS VARCHAR) AS task, round(n_chars / 1000.0::DOUBLE * 100, 6) AS score FROM documents WHERE doc_id % 3 < 2")
def task_results(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat("lang", F.col("doc_id").cast("string"))
    acc = F.when(F.col("doc_id") % 3 == 0, F.lit("acc")).when(F.col("doc_id") % 3 == 1, F.lit("acc_norm")).otherwise(F.lit("f1"))
    one = F.create_map(F.concat(name, F.lit(",none")), F.create_map(acc, (F.col("n_chars") / 1000).cast("string")))
    return evaluation.task_results(t.select(F.to_json(F.struct(one.alias("results"))).alias("value"))).withColumn("score", r6("score"))


# -- enrichment with the echo model, which answers with the last line of a prompt --


def _last(x: str) -> str:
    lines = f"regexp_split_to_array({x}, '[\\x{{a}}-\\x{{d}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"list_filter(list_transform({lines}, lambda y: {_strip('y')}), lambda y: y <> '')[-1]"




@query(
    f"WITH {PAIRS}, {SCORED}, w AS (SELECT *, score < 0.95::DOUBLE AS wanted, {_last("'Answer: ' || output")} AS said FROM q)"
    " SELECT id, CASE WHEN wanted THEN said ELSE output END AS output, wanted AS synthesized FROM w"
)
def synthesis_stub(spark, d):
    scored = set_meta(pairs(spark, d), quality_score=QualityFilter().score())
    return LLMSynthesis("echo", quality_threshold=0.95).apply(scored).select("id", "output", F.coalesce("meta.synthesized", F.lit(False)).alias("synthesized"))


@query(
    f"WITH {PAIRS}, w AS (SELECT *, category = 'reasoning' AND NOT {_any('lower(output)', scores.CHAINED)} AS wanted, {_last("'Task: ' || instruction")} AS said FROM s),"
    f" n AS (SELECT *, list_distinct(regexp_extract_all(output, '{_NUM}')) AS a, list_distinct(regexp_extract_all(said, '{_NUM}')) AS b FROM w),"
    " k AS (SELECT *, wanted AND (len(a) = 0 OR len(list_intersect(a, b)) / len(a)::DOUBLE >= 0.5::DOUBLE) AS enhanced FROM n)"
    " SELECT id, CASE WHEN enhanced THEN said ELSE output END AS output, enhanced FROM k"
)
def reasoning_stub(spark, d):
    return ReasoningChainEnhancer("echo").apply(pairs(spark, d)).select("id", "output", F.coalesce("meta.has_reasoning_chain", F.lit(False)).alias("enhanced"))


# -- stages, pipelines and configurations --

_TESTS = " ".join(f"WHEN {test} THEN '{kind}'" for test, kind, *_ in sorted(_RULES, key=lambda r: -r[2]))
CURATED = f"f AS (SELECT *, {_norm('instruction')} AS key FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1), q AS (SELECT *, {QUALITY} AS score FROM f), c AS (SELECT * FROM q WHERE round(score, 9) >= 0.7::DOUBLE)"
CLEAN = f"SELECT id, instruction, output FROM c WHERE coalesce(CASE {_TESTS} END, 'none') <> 'error'"


@query(f"WITH {PAIRS}, {CURATED} {CLEAN}")
def pipeline_stages(spark, d):
    """Two stages, each with a written checkpoint, and a third run that resumes from the first one."""
    made = lambda: [CurateStage([ExactDedup(), QualityFilter(0.7)]), ReasoningStage([NoiseDetector()])]
    folder, samples = new_path(spark, "checkpoints"), Samples(pairs(spark, d))
    Pipeline(stages=made(), checkpoint_dir=folder).run(samples)
    return Pipeline(stages=made(), checkpoint_dir=folder).run(samples, "s1_data_juicer").data.df.select("id", "instruction", "output")


@query(f"WITH {PAIRS}, {CURATED} {CLEAN}")
def pipeline_of_configuration(spark, d):
    stages = [
        {"name": "data_juicer", "operators": [{"name": "exact_dedup"}, {"name": "quality_filter", "params": {"threshold": 0.7}}, {"name": "diversity_filter", "enabled": False}]},
        {"name": "reasoning_enhance", "operators": [{"name": "noise_detector"}]},
    ]
    config = PipelineConfig.of({"name": "named", "stages": stages, "checkpoint_enabled": False, "unknown_key": 1})
    return Pipeline(config).run(Samples(pairs(spark, d))).data.df.select("id", "instruction", "output")


@query(f"WITH {PAIRS}, {CURATED} {CLEAN}")
def stage_by_name(spark, d):
    s = Pipeline(stages=[CurateStage([ExactDedup(), QualityFilter(0.7)])]).run_stage("s1_data_juicer", Samples(pairs(spark, d)))
    return ReasoningStage([NoiseDetector()]).process(s).df.select("id", "instruction", "output")


@query()
def full_curate_stage(spark, d):
    """All four operators of the first stage with their defaults, but for the number wanted."""
    return CurateStage(target_count=60, quality_threshold=0.6).process(Samples(pairs(spark, d))).df.select("id")


@query()
def full_knowledge_stage(spark, d):
    return KnowledgeStage(top_k=40, llm={"llm_backend": "echo"}).process(Samples(pairs(spark, d))).df.select("id", "output")


@query()
def full_reasoning_stage(spark, d):
    return ReasoningStage(llm={"llm_backend": "echo"}).process(Samples(pairs(spark, d))).df.select("id", "output")
