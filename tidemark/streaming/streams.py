"""The row-level operators over Structured Streaming.

Scores, rules and filters keep no state. Dedup keeps keys: the first of them to arrive stays, and with a watermark on an
event time the keys are dropped when it has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators.dedup import ExactDedup
from tidemark.operators.filters import DIGITS

SCHEMA = "id string, instruction string, input string, output string, category string, ts timestamp"


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """JSON lines that arrive in a folder; nulls take the samples' defaults."""
    return spark.readStream.schema(schema).json(path).fillna("", ["instruction", "input", "output"]).fillna("other", ["category"])


def curate(stream: DataFrame, threshold: float = 0.8, dedup: str | None = None, watermark: str | None = None) -> DataFrame:
    """``stream`` with quality score, surest issue and category flags; rows under the threshold or with an error go."""
    out = stream.withColumn("quality_score", scores.quality_score(F.col("instruction"), F.col("output")))
    out = out.withColumn("issue", scores.primary_issue(scores.noise_issues(F.col("instruction"), F.col("output"))))
    out = out.withColumn("enhance", scores.should_enhance(F.col("category"), F.col("output"), F.lit(False)))
    out = out.where(F.round("quality_score", DIGITS) >= threshold).where(~F.coalesce(F.col("issue.noise_type") == "error", F.lit(False)))
    if dedup:
        out = out.withColumn("_key", ExactDedup(dedup).key())
        out = out.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["_key"]) if watermark else out.dropDuplicates(["_key"])
        out = out.drop("_key")
    return out


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Works off what is there into Parquet, exactly once, and reads the result."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
