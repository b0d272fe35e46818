"""The corpus pipeline: quality, lines, near duplicates, benchmark passages, then packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``.

In every stage null and empty texts have no part in the decision and stay; a null in another column is a value like any
other (a null language is one of its own, a document without an id is in no group of copies); texts are read whole;
repeated rows are decided alike and all stay or go together, but those of a group of copies, of whose ids one stays;
empty tables give empty ones; columns besides those of ``documents`` would pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, minhash, packing, quality
from tidemark.llm.common import written

#: Perplexity, the forest and packing aren't for SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose perplexity or toxicity is beyond their language's fence go; one at it stays. Without
    labels, or without trusted text in a language, all stay."""
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines of many documents go; ``n_chars`` follows the text, and is null for a null text. A document that
    loses every line stays, empty."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near duplicates the document with the least id stays; a text without a word is in no
    group."""
    return minhash.near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents with a passage of the benchmark go, and those that are a short item as a whole."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: a place in a bin for every token that is left; a text without tokens has none."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all tokens of ``documents`` that the stages leave; empty for an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
