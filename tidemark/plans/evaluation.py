"""Dataset metrics, human evaluation and comparison of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ends(column: Column, name: str) -> list[Column]:
    return [F.avg(column).alias(f"{name}_mean"), F.min(column).cast("double").alias(f"{name}_min"), F.max(column).cast("double").alias(f"{name}_max")]


def dataset_metrics(df: DataFrame) -> DataFrame:
    """One row of a dataset's metrics, in one pass: scores (0.5 where missing), lengths, variety and coverage."""
    n = F.count("*")
    rate = lambda c: F.coalesce(c / F.nullif(n, F.lit(0)), F.lit(0.0))
    chained, made = F.count_if(F.coalesce("meta.has_reasoning_chain", F.lit(False))), F.count_if(F.coalesce("meta.synthesized", F.lit(False)))
    distinct = F.count_distinct("instruction")
    return df.agg(
        n.alias("total"), *_ends(F.coalesce("meta.knowledge_score", F.lit(0.5)), "knowledge"), *_ends(F.coalesce("meta.quality_score", F.lit(0.5)), "quality"),
        *_ends(F.length("instruction"), "instruction_length"), *_ends(F.length("output"), "output_length"),
        distinct.alias("unique_instructions"), rate(distinct).alias("unique_ratio"),
        chained.alias("reasoning_count"), rate(chained).alias("reasoning_rate"), made.alias("synthesis_count"), rate(made).alias("synthesis_rate"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"))


def metrics_dict(df: DataFrame) -> dict:
    found = dataset_metrics(df).first().asDict()
    return found | {"categories": {r.category: r.n for r in category_counts(df).orderBy(F.desc("n"), "category").toLocalIterator()}}


# -- human evaluation --

SHEET = "question_id long, instruction string, responses array<struct<response_id string, content string, _model string, scores map<string,double>>>"


def blind_sheet(questions: DataFrame, answers: DataFrame, dimensions: tuple[str, ...] = ("accuracy", "completeness", "fluency"), seed: int = 42) -> DataFrame:
    """A sheet of (question_id, instruction) and (question_id, model, content): answers in a seeded order, without scores."""
    order = F.xxhash64(F.lit(seed), "question_id", "model")
    ranked = answers.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy(order, "model")))
    empty = F.create_map(*[x for d in dimensions for x in (F.lit(d), F.lit(None).cast("double"))])
    one = F.struct(F.char(F.col("_n") + 64).alias("response_id"), F.coalesce("content", F.lit("")).alias("content"), F.col("model").alias("_model"))
    rows = ranked.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.withField("scores", empty)).alias("responses"))
    return questions.select("question_id", "instruction").join(rows, "question_id")


def human_scores(sheet: DataFrame) -> DataFrame:
    """(model, score): the mean over responses of the mean of each one's scores; null for a model without scores."""
    r = sheet.select("question_id", F.posexplode("responses").alias("at", "r"))
    s = r.select("question_id", "at", F.col("r._model").alias("model"), F.explode_outer(F.map_values("r.scores")).alias("s"))
    return s.groupBy("question_id", "at", "model").agg(F.avg("s").alias("s")).groupBy("model").agg(F.avg("s").alias("score"))


def task_results(raw: DataFrame) -> DataFrame:
    """(task, score) in per cent from rows with a JSON column ``value``: ``results`` -> task -> ``acc``, or else ``acc_norm``."""
    parsed = F.from_json("value", "struct<results: map<string, map<string, string>>>")
    t = raw.select(F.explode(parsed["results"]).alias("task", "m"))
    score = F.coalesce(F.try_element_at("m", F.lit("acc")), F.try_element_at("m", F.lit("acc_norm"))).cast("double") * 100
    return t.select(F.substring_index("task", ",", 1).alias("task"), score.alias("score")).where("score IS NOT NULL")


def relative_to(scores: DataFrame, baseline: str, near: float = 90, reached: float = 95) -> DataFrame:
    """(model, score, relative, verdict): per cent of one model's score, in bands."""
    base = scores.where(F.col("model") == baseline).select(F.col("score").alias("_b")).limit(1)  # one row
    rel = F.when(F.col("_b") > 0, F.col("score") / F.col("_b") * 100)
    verdict = F.when(rel >= reached, "reached").when(rel >= near, "near").when(rel.isNotNull(), "missed")
    return scores.join(F.broadcast(base), how="left").select("model", "score", rel.alias("relative"), verdict.alias("verdict"))


def comparison_table(results: dict[str, dict], baseline: str = "baseline_10k", metric: str = "ceval") -> str:
    """A Markdown table of models by metric, with per cent of the baseline."""
    names = sorted({k for r in results.values() for k in r})
    base = results.get(baseline, {}).get(metric, 0)
    lines = ["| model | " + " | ".join(names) + " | relative |", "|---" * (len(names) + 2) + "|"]
    for model, r in results.items():
        rel = f"{r[metric] / base * 100:.1f}%" if base and metric in r else "-"
        lines.append(f"| {model} | " + " | ".join(f"{r[k]:.1f}" if k in r else "-" for k in names) + f" | {rel} |")
    return "\n".join(lines)
