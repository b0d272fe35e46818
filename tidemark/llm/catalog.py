"""The operators as named queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, media, minhash, packing, quality, records, sql, substring_dedup, suffix_dedup, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id", "lang", "source"])
    return found.where("keep").select("r.doc_id", "r.lang", "r.source", "perplexity", "score", "threshold")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_streams(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_records(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = [op1_suffix_array_dedup, op2_benchmark_decontamination, op3_html_extraction, op4_quality_classifier, op5_line_dedup, op6_media_columns, op7_best_fit_packing, op8_token_records, op9_substring_dedup, op10_minhash_near_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op1_suffix_array_dedup": sql.PASSAGES, "op2_benchmark_decontamination": sql.CONTAMINATION, "op5_line_dedup": line_dedup.SQL, "op9_substring_dedup": sql.PASSAGES}
