"""Quality, knowledge and noise: scores and rules as native Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions.text import once, words
from tidemark.operators.base import FilterOperator, Operator, TransformOperator, Watch, unwatched
from tidemark.schema import reorder, set_meta

DIGITS = 9


class QualityFilter(Operator):
    """Keeps samples whose quality score reaches a threshold; the score is stored."""

    name = "quality_filter"

    defaults = dict(threshold=0.8, min_output_length=20, max_output_length=8000, min_instruction_length=10, max_instruction_length=2000, scorer="heuristic")

    def score(self) -> Column:
        bounds = self.min_instruction_length, self.max_instruction_length, self.min_output_length, self.max_output_length
        return scores.quality_score(F.col("instruction"), F.col("output"), *bounds)

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        s = F.col("meta.quality_score")
        cols = df.columns
        df = set_meta(df.withColumn("_q", once(self.score())), quality_score=F.col("_q")).select(*cols)
        df = watch(df, "in", avg_score=F.avg(s), min_score=F.min(s), max_score=F.max(s))
        return watch(df.filter(F.round(s, DIGITS) >= self.threshold), "out")

    def measured(self, into: dict, out: dict) -> dict:
        return super().measured(into, out) | {"threshold": self.threshold}


def quality_metrics(df: DataFrame, operator: QualityFilter) -> DataFrame:
    """One row: counts, rate, threshold and the scores' mean and ends over all rows."""
    s = operator.score()
    kept = F.count_if(F.round(s, DIGITS) >= operator.threshold)
    n = F.count("*")
    return df.agg(
        n.alias("input_count"), kept.alias("output_count"), (n - kept).alias("filtered_count"),
        F.coalesce((n - kept) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("filter_rate"), F.lit(operator.threshold).alias("threshold"),
        F.round(F.avg(s), DIGITS).alias("avg_score"), F.round(F.min(s), DIGITS).alias("min_score"), F.round(F.max(s), DIGITS).alias("max_score"),
    )


def with_word_parts(df: DataFrame) -> DataFrame:
    """``df`` with ``_parts``, the sum of entropy, length and variety of a row's words, and ``_of``, how many of them count.

    A row's words are sorted and their runs summed in one fold, so nothing is shuffled and a text costs little more than
    its length.
    """
    df = df.withColumn("_w", F.array_sort(words(F.lower(F.concat("instruction", F.lit(" "), "output"))))).withColumn("_t", F.size("_w").cast("double"))

    def gain(a: Column) -> Column:
        p = a["run"] / a["total"]
        return F.when(a["run"] > 0, -p * F.log2(p + 1e-10)).otherwise(0.0)

    def state(w: Column, run: Column, h: Column, kinds: Column, total: Column) -> Column:
        return F.struct(w.alias("w"), run.alias("run"), h.alias("h"), kinds.alias("kinds"), total.alias("total"))

    zero, one = F.lit(0.0), F.lit(1.0)
    folded = F.aggregate(
        "_w", state(F.lit(""), zero, zero, zero, F.col("_t")),  # the total is in the state: the step reads nothing else, however the plan is folded
        lambda a, x: F.when(a["w"] == x, state(a["w"], a["run"] + 1.0, a["h"], a["kinds"], a["total"])).otherwise(state(x, one, a["h"] + gain(a), a["kinds"] + 1.0, a["total"])),
        lambda a: F.struct((a["h"] + gain(a)).alias("h"), a["kinds"].alias("kinds")),
    )
    df = df.withColumn("_f", folded)
    some, length = F.col("_t") > 0, F.least(F.lit(1.0), F.length("output") / 1000)
    worded = F.least(F.lit(1.0), F.col("_f.h") / 8) + F.col("_f.kinds") / F.greatest(F.col("_t"), F.lit(1.0))
    return df.withColumns({"_parts": length + F.when(some, worded).otherwise(0.0), "_of": F.when(some, 3).otherwise(1)}).drop("_w", "_t", "_f")


def knowledge_scores(df: DataFrame, corpus: DataFrame | None = None, vector: str = "vec") -> DataFrame:
    """``df`` with ``knowledge_score`` and ``ref_sim``, the cosine of the nearest text of a reference corpus.

    ``corpus`` has unit vectors in ``vector``, and so must ``df``; blocks of both meet in matrix products.
    """
    cols = df.columns
    df = with_word_parts(df)
    if corpus is None:
        return df.select(*cols, (F.col("_parts") / F.col("_of")).alias("knowledge_score"), F.lit(None).cast("double").alias("ref_sim"))
    from tidemark.operators.dedup import nearest

    right = corpus.select(F.xxhash64(vector).alias("r"), F.col(vector).alias("vec")).dropDuplicates(["r"])
    near = nearest(df.select(F.col("_ord").alias("l"), F.col(vector).alias("vec")), right, 1, 12, cosine=False).select(F.col("l").alias("_ord"), F.col("sim").alias("ref_sim"))
    df = df.join(near, "_ord", "left")
    score = F.when(F.col("ref_sim").isNotNull(), (F.col("_parts") + F.col("ref_sim")) / (F.col("_of") + 1)).otherwise(F.col("_parts") / F.col("_of"))
    return df.select(*cols, score.alias("knowledge_score"), "ref_sim")


class KnowledgeFilter(Operator):
    """Keeps the samples with most knowledge, in that order: the best ``top_k``, or all from ``min_score`` on."""

    name = "knowledge_filter"

    defaults = dict(top_k=1000, min_score=None, embedding_model=None, embedding_backend="hashing")
    corpus: list[str] | None = None

    def set_reference_corpus(self, texts) -> None:
        """Texts whose nearest one counts as a part of the score."""
        self.corpus = list(texts)

    def scored(self, df: DataFrame) -> DataFrame:
        if self.corpus is None:  # vectors would go unused
            found = knowledge_scores(df)
        else:
            from tidemark.backends.embeddings import embed_column, get_embedding

            spark = df.sparkSession
            name, model = self.embedding_backend, self.embedding_model
            backend = lambda: get_embedding(name, model)
            corpus = embed_column(spark.createDataFrame([(t,) for t in self.corpus], "t string"), "t", "vec", backend)
            found = knowledge_scores(embed_column(df.withColumn("t", F.concat("instruction", F.lit(" "), "output")), "t", "vec", backend), corpus)
        return set_meta(found, knowledge_score=F.col("knowledge_score")).select(*df.columns)

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        s = F.col("meta.knowledge_score")
        df = watch(self.scored(df), "in", avg_score=F.avg(s))
        best = (F.round(s, DIGITS).desc(), F.col("_ord"))
        if self.min_score is not None:
            kept = reorder(df.filter(F.round(s, DIGITS) >= self.min_score), *best)
        else:
            kept = df.orderBy(*best).limit(self.top_k).drop("_ord").withColumn("_ord", F.monotonically_increasing_id())
        return watch(kept.select(*df.columns), "out", min_kept_score=F.coalesce(F.min(s), F.lit(0.0)), max_score=F.max(s))


class NoiseDetector(Operator):
    """Finds noisy samples by rules and removes, flags or keeps them by kind."""

    name = "noise_detector"

    defaults = dict(method="heuristic", threshold=0.5, action_ambiguity="flag", action_error="remove", action_redundancy="remove")

    def prepare(self) -> None:
        self.actions = {kind: getattr(self, f"action_{kind}") for kind in ("error", "redundancy", "ambiguity")}

    def judged(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_issues``, ``_primary`` and ``_action``."""
        df = df.withColumn("_issues", once(scores.noise_issues(F.col("instruction"), F.col("output"))))
        df = df.withColumn("_primary", once(scores.primary_issue(F.col("_issues"))))
        act = F.lit("keep")
        for kind, what in self.actions.items():
            act = F.when(F.col("_primary.noise_type") == kind, what if what in ("remove", "flag") else "keep").otherwise(act)
        sure = F.coalesce(F.col("_primary.confidence") >= self.threshold, F.lit(False))
        return df.withColumn("_action", F.when(sure, act).otherwise("keep"))

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        cols = df.columns
        df = self.judged(df)
        p = F.col("_primary")
        found = F.when(
            p.isNotNull(),
            F.struct(p["noise_type"].alias("noise_type"), p["confidence"].alias("confidence"), p["reason"].alias("reason"), F.col("_issues").alias("all_issues")),
        ).otherwise(F.struct(F.lit("none").alias("noise_type"), F.lit(0.0).alias("confidence"), F.lit("no_issues").alias("reason"), F.lit(None).cast(df.schema["_issues"].dataType).alias("all_issues")))
        flag = F.col("_action") == "flag"
        df = set_meta(
            df, noise_detection=found,
            flagged=F.when(flag, True).otherwise(F.col("meta.flagged")), flag_reason=F.when(flag, p["reason"]).otherwise(F.col("meta.flag_reason")),
        )
        df = watch(df, "in", removed_count=F.count_if(F.col("_action") == "remove"), flagged_count=F.count_if(flag), noisy_count=F.count_if(p.isNotNull()))
        return watch(df.filter(F.col("_action") != "remove").select(*cols), "out")


class LengthFilter(FilterOperator):
    """An example of an extension: keeps samples whose output has a length in a range."""

    name = "length_filter"

    defaults = dict(min_length=50, max_length=5000)

    def keep(self) -> Column:
        return F.length("output").between(self.min_length, self.max_length)


class PrefixAdder(TransformOperator):
    """An example of an extension: puts a prefix before the output."""

    name = "prefix_adder"

    defaults = dict(prefix="Answer: ")

    def change(self) -> dict[str, Column]:
        return {"output": F.concat(F.lit(self.prefix), "output")}
