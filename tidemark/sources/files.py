"""Readers and writers of sample files: JSON lines, JSON arrays, Parquet and CSV."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import Samples
from tidemark.functions.scores import category_by_count
from tidemark.functions.text import strip
from tidemark.schema import META, number, to_samples
from tidemark.sources.local import save_json, save_text

_RAW = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "instruction", "input", "output", "category", "metadata", "meta", "metadata_json")] + [T.StructField("_ord", T.LongType())])
QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])


def suffix_of(path: str) -> str:
    return Path(path).suffix.lower()


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; blank lines are skipped, a broken one is an error. Line order is kept as ``_ord``."""
    raw = spark.read.schema(_RAW).option("mode", "FAILFAST").json(path)
    rows = number(raw.withColumn("meta", F.coalesce(F.from_json("meta", META), F.from_json("metadata", META))).withColumnRenamed("_ord", "_given"))
    return to_samples(rows.withColumn("_ord", F.coalesce("_given", "_ord")).drop("_given"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return to_samples(rows if "_ord" in rows.columns else number(rows))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; all columns are text, quotes may hold line ends."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return to_samples(rows if "_ord" in rows.columns else number(rows))


READERS = {".jsonl": read_jsonl, ".json": read_jsonl, ".parquet": read_parquet, ".csv": read_csv}


def read_data(spark: SparkSession, path: str) -> Samples:
    """Reads by suffix: .jsonl and .json by lines, .parquet, .csv."""
    reader = READERS.get(suffix_of(path))
    if reader is None:
        raise ValueError(f"unknown file type of {path}; known: {', '.join(READERS)}")
    return Samples(reader(spark, path), (f"loaded from {path}",))


def write_jsonl(samples: Samples, path: str, single: bool = False) -> None:
    """JSON lines in order, nulls written; ``metadata`` holds the row's own JSON and the typed fields that are set."""
    df = samples.df.repartition(1).sortWithinPartitions("_ord") if single else samples.df.orderBy("_ord")
    fields = F.to_json(F.struct("id", "instruction", "input", "output", "category"), {"ignoreNullFields": "false"})
    typed = F.to_json("meta", {"ignoreNullFields": "true"})
    own = F.coalesce(F.col("metadata_json"), F.lit("{}"))
    both = F.concat(own.substr(F.lit(1), F.length(own) - 1), F.lit(","), typed.substr(F.lit(2), F.length(typed)))  # of a key in both, the later counts
    metadata = F.when(typed == "{}", own).when(own == "{}", typed).otherwise(both)
    line = F.concat(fields.substr(F.lit(1), F.length(fields) - 1), F.lit(',"metadata":'), metadata, F.lit("}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_parquet(samples: Samples, path: str) -> None:
    """Parquet with all columns, ``meta`` and order included."""
    samples.df.write.mode("overwrite").parquet(path)


WRITERS = {".jsonl": write_jsonl, ".json": write_jsonl, ".parquet": write_parquet}


def write_data(samples: Samples, path: str) -> None:
    writer = WRITERS.get(suffix_of(path))
    if writer is None:
        raise ValueError(f"unknown file type of {path}; known: {', '.join(WRITERS)}")
    writer(samples, path)


# -- question and answer files, and files for fine-tuning --


def convert_qa(df: DataFrame, prefix: str = "baike") -> DataFrame:
    """Samples of (question, answer[, _ord]) rows: trimmed, numbered ids, category by keywords."""
    rows = df if "_ord" in df.columns else number(df)
    q, a = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer"))
    key = F.concat(F.lit(f"{prefix}_"), F.when(F.col("_ord") < 1_000_000, F.lpad(F.col("_ord").cast("string"), 6, "0")).otherwise(F.col("_ord").cast("string")))
    return to_samples(rows.select(key.alias("id"), q.alias("instruction"), F.lit("").alias("input"), a.alias("output"), category_by_count(q).alias("category"), "_ord"))


def load_raw(spark: SparkSession, path: str, limit: int | None = None, schema: T.StructType = QA) -> DataFrame:
    """JSON lines with their order; the first ``limit`` of them."""
    rows = number(spark.read.schema(schema).option("mode", "FAILFAST").json(path))
    return rows if not limit else rows.orderBy("_ord").limit(limit)


def sft_rows(df: DataFrame) -> DataFrame:
    """(instruction, input, output[, _ord]) of samples or of question and answer rows; input is empty."""
    have = df.columns
    pick = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in have], F.lit(""))
    order = [F.col("_ord")] if "_ord" in have else []
    return df.select(pick("instruction", "question").alias("instruction"), F.lit("").alias("input"), pick("output", "answer").alias("output"), *order)


def write_sft(df: DataFrame, path: str) -> int:
    """One JSON array file, streamed to the driver row by row in order; returns the number of rows."""
    rows, n = sft_rows(df), 0
    save_text(path, "")
    if "_ord" in rows.columns:
        rows = rows.orderBy("_ord").drop("_ord")
    with Path(path).open("a", encoding="utf-8") as out:
        for r in rows.toLocalIterator():
            print(",\n" if n else "[\n", json.dumps(r.asDict(), ensure_ascii=False), sep="", end="", file=out)
            n += 1
        print("\n]" if n else "[]", file=out)
    return n


def dataset_registry(names: list[str]) -> dict:
    """Name -> file and column map, for a fine-tuning tool."""
    columns = dict(zip(("prompt", "query", "response"), ("instruction", "input", "output")))
    return {n: dict(file_name=f"{n}.json", columns=columns) for n in names}


def write_registry(names: list[str], path: str) -> None:
    save_json(path, dataset_registry(names))


def set_statistics(df: DataFrame) -> DataFrame:
    """(file, n, mean_instruction, mean_output) of each file that a frame was read from."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.avg(F.length("instruction")).alias("mean_instruction"), F.avg(F.length("output")).alias("mean_output"))
