"""Selection of a varied subset by embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.base import Operator, Watch, unwatched
from tidemark.schema import set_meta

POOL = 2000


def farthest_first(v: np.ndarray, count: int, start: int = 0, digits: int = 9) -> list[int]:
    """Rows chosen one by one: each time the one whose greatest cosine to those chosen is least, the first of equals."""
    v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    picked = [start]
    most = np.round(v @ v[start], digits)
    most[start] = np.inf
    while len(picked) < min(count, len(v)):
        k = int(np.argmin(most))
        picked.append(k)
        most = np.maximum(most, np.round(v @ v[k], digits))
        most[k] = np.inf
    return picked


def maxmin(df: DataFrame, count: int, pool: int = POOL, digits: int = 9) -> DataFrame:
    """(_ord, rank) of a farthest-first selection over ``vec``, from the first row on; exact at every size.

    A row's greatest cosine to the rows chosen only grows as more are chosen. So a pass over all rows brings the ``pool``
    rows with the least of it to the driver, and the choice goes on among these, exactly, until the next one might be a
    row outside; then comes another pass. Passes are distributed and shuffle nothing but each task's best rows. ``df`` is
    read once a pass, so it should be a stored table.
    """
    spark = df.sparkSession
    rows = df.select("_ord", F.col("vec").cast("array<double>").alias("vec"))
    first = rows.orderBy("_ord").limit(1).collect() if count > 0 else []
    taken: list[int] = [r._ord for r in first]
    chosen = [unit_row(r.vec) for r in first]
    while taken and len(taken) < count:
        against, known = np.array(chosen), np.array(taken)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[~np.isin(pdf["_ord"].to_numpy(), known)]
                if len(pdf):
                    v = np.array(pdf["vec"].tolist())
                    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
                    yield pdf.assign(most=np.round(v @ against.T, digits).max(axis=1))

        found = rows.mapInPandas(score, "_ord long, vec array<double>, most double").orderBy("most", "_ord").limit(pool + 1).collect()
        if not found:
            break
        bound = (found[-1].most, found[-1]._ord) if len(found) > pool else None  # every row outside is at least here
        near = found[:pool]
        ids, most = np.array([r._ord for r in near]), np.array([r.most for r in near])
        v = np.array([unit_row(r.vec) for r in near])
        while len(taken) < count:
            k = int(np.lexsort((ids, most))[0])
            if np.isinf(most[k]) or bound is not None and (most[k], ids[k]) > bound:
                break
            taken.append(int(ids[k]))
            chosen.append(v[k])
            most = np.maximum(most, np.round(v @ v[k], digits))
            most[k] = np.inf
    return spark.createDataFrame([(o, i) for i, o in enumerate(taken)], "_ord long, rank int")


def unit_row(v: list[float]) -> np.ndarray:
    a = np.asarray(v, np.float64)
    return a / (np.linalg.norm(a) + 1e-9)


def kmeans(df: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(_ord, rank): the row nearest to each centre of a k-means clustering of ``vec``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select("_ord", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=count, seed=seed).fit(rows)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    near = model.transform(rows).select("_ord", "prediction").join(df.select("_ord", "vec"), "_ord").join(centres, "prediction")
    far = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("prediction").orderBy("_far", "_ord")
    return near.withColumn("_far", far).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("_ord", F.col("prediction").alias("rank"))


def diversity_score(df: DataFrame, vector: str = "vec") -> DataFrame:
    """One row: one less the mean cosine of all pairs, from sums by dimension; 1 for fewer than two rows."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-9
    e = df.select(F.posexplode(F.transform(vector, lambda x: x.cast("double") / norm)).alias("d", "x"))
    dims = e.groupBy("d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    n = F.max("n")
    mean = (F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (n * (n - 1))
    return dims.agg(F.when(F.coalesce(n, F.lit(0)) < 2, 1.0).otherwise(1 - mean).alias("diversity_score"))


def category_diversity(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n"))


class DiversityFilter(Operator):
    """Chooses a number of samples that differ: farthest first, by clusters, or at random."""

    name = "diversity_filter"

    defaults = dict(target_count=1000, selection_method="maxmin", seed=42, embedding_model=None, embedding_backend="hashing")

    def prepare(self) -> None:
        self.count, self.method = self.target_count, self.selection_method

    def vectors(self, df: DataFrame) -> DataFrame:
        from tidemark.backends.embeddings import embed_column, get_embedding
        from tidemark.plans.storage import stored

        backend, model = self.embedding_backend, self.embedding_model
        text = F.concat("instruction", F.lit(" "), "output")
        return stored(embed_column(df.select("_ord", text.alias("t")), "t", "vec", lambda: get_embedding(backend, model)).select("_ord", "vec"), "vectors")

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        if df.limit(self.count + 1).count() <= self.count:
            return watch(watch(df, "in"), "out")
        if self.method == "maxmin":
            picked = maxmin(self.vectors(df), self.count)
        elif self.method == "kmeans":
            picked = kmeans(self.vectors(df), self.count, self.seed)
        else:
            key = F.md5(F.concat(F.lit(f"{self.seed}:"), "id"))
            picked = df.orderBy(key, "id", "_ord").limit(self.count).select("_ord", F.monotonically_increasing_id().alias("rank"))
        kept = set_meta(watch(df, "in").join(picked, "_ord"), diversity_selected=F.lit(True))
        return watch(kept.withColumn("_ord", F.col("rank").cast("long")).select(*df.columns), "out")
