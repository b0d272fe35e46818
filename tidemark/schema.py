"""The sample schema: what every operator takes and returns."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("id", "instruction", "input", "output", "category")
DEFAULTS = {"instruction": "", "input": "", "output": "", "category": "other"}

ISSUE = T.StructType([T.StructField("noise_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("reason", T.StringType())])
META = T.StructType(
    [
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("knowledge_score", T.DoubleType()),
        T.StructField("diversity_selected", T.BooleanType()),
        T.StructField("synthesized", T.BooleanType()),
        T.StructField("synthesis_style", T.StringType()),
        T.StructField("synthesis_error", T.StringType()),
        T.StructField("has_reasoning_chain", T.BooleanType()),
        T.StructField("chain_style", T.StringType()),
        T.StructField("original_output", T.StringType()),
        T.StructField("reasoning_verification_failed", T.BooleanType()),
        T.StructField("reasoning_error", T.StringType()),
        T.StructField(
            "noise_detection",
            T.StructType(
                [
                    T.StructField("noise_type", T.StringType()),
                    T.StructField("confidence", T.DoubleType()),
                    T.StructField("reason", T.StringType()),
                    T.StructField("all_issues", T.ArrayType(ISSUE)),
                ]
            ),
        ),
        T.StructField("flagged", T.BooleanType()),
        T.StructField("flag_reason", T.StringType()),
    ]
)
SAMPLE = T.StructType(
    [T.StructField(f, T.StringType()) for f in FIELDS]
    + [T.StructField("meta", META), T.StructField("metadata_json", T.StringType()), T.StructField("_ord", T.LongType())]
)


def to_samples(df: DataFrame) -> DataFrame:
    """``df`` under the sample schema: missing columns and nulls take their defaults, other columns are dropped.

    A missing id is the md5 of the row's texts and place, so that a retry gives the same one. A frame
    without ``_ord`` keeps its scan order.
    """
    have = set(df.columns)
    if "_ord" not in have:
        df = df.withColumn("_ord", F.monotonically_increasing_id())
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d) for c, d in DEFAULTS.items()}
    made = F.md5(F.concat_ws("\x1f", cols["instruction"], cols["input"], cols["output"], F.col("_ord").cast("string")))
    key = F.coalesce(F.col("id").cast("string"), made) if "id" in have else made
    kind = META.simpleString()
    if "meta" in have and df.schema["meta"].dataType == META:
        meta = F.col("meta")
    elif "metadata" in have:
        raw = df.schema["metadata"].dataType
        meta = F.from_json(F.col("metadata") if isinstance(raw, T.StringType) else F.to_json("metadata"), META)
    else:
        meta = F.lit(None)
    meta = F.coalesce(meta.cast(kind), F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in META.fields]))
    extra = F.col("metadata_json") if "metadata_json" in have else F.lit(None)
    if "metadata" in have and "metadata_json" not in have:
        extra = F.col("metadata") if isinstance(df.schema["metadata"].dataType, T.StringType) else F.to_json("metadata")
    return df.select(key.alias("id"), *[v.alias(c) for c, v in cols.items()], meta.alias("meta"), extra.cast("string").alias("metadata_json"), F.col("_ord").cast("long").alias("_ord"))


def number(df: DataFrame) -> DataFrame:
    """``df`` with its rows numbered from 0 in scan order; for plain scans, whose partitions are the same each time.

    Of files the order is that of their names, a run of digits counting as a number, and then of their lines: Spark gives
    files to tasks by size. Counts (a number for each partition and piece of a file) turn Spark's increasing ids into
    dense ones without a shuffle.
    """
    rows = df.withColumns({"_ord": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    try:
        rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})
    except AnalysisException:  # no files
        rows = rows.withColumns({"_file": F.lit(""), "_start": F.col("_part").cast("long")})
    key = ["_part", "_file", "_start"]
    pieces = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("_ord").alias("first")).collect()  # as many as pieces of files
    table, at = [], 0
    for r in sorted(pieces, key=lambda r: ([int(x) if k % 2 else x for k, x in enumerate(re.split(r"([0-9]+)", r._file))], r._start)):
        table.append((r._part, r._file, r._start, at - r.first))
        at += r.n
    moves = df.sparkSession.createDataFrame(table, "_part int, _file string, _start long, _by long")
    moved = rows.join(F.broadcast(moves), key)
    return moved.withColumn("_ord", F.col("_ord") + F.col("_by")).select(*df.columns, "_ord")


def reorder(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``_ord`` anew in the order given: increasing, not dense. ``order`` should leave no ties."""
    return df.orderBy(*order).drop("_ord").withColumn("_ord", F.monotonically_increasing_id())


def set_meta(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with fields of its ``meta`` replaced."""
    meta = F.col("meta")
    for name, value in values.items():
        meta = meta.withField(name, value.cast(META[name].dataType))
    return df.withColumn("meta", meta)
