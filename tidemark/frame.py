"""Samples: an ordered frame of samples with a record of its steps."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import SAMPLE, to_samples

#: Positions from an end that are found by sorting.
NEAR = 100


class Samples:
    """A DataFrame under the sample schema, in the order of ``_ord``, and the steps that made it. Nothing runs until asked."""

    def __init__(self, df: DataFrame, provenance: tuple[str, ...] = ()) -> None:
        self.df, self.provenance = df, tuple(provenance)
        self._metrics: dict[str, object] = {}

    # -- making --

    @classmethod
    def from_list(cls, spark: SparkSession, rows: list[dict]) -> Samples:
        import json

        full = [
            (None if r.get("id") is None else str(r["id"]), *(r.get(k) for k in ("instruction", "input", "output", "category")), None if not r.get("metadata") else json.dumps(r["metadata"], ensure_ascii=False), i)
            for i, r in enumerate(rows)
        ]
        df = spark.createDataFrame(full, "id string, instruction string, input string, output string, category string, metadata string, _ord long")
        return cls(to_samples(df), ("loaded from list",))

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> Samples:
        return cls(to_samples(df), ("loaded from dataframe",))

    @classmethod
    def from_jsonl(cls, spark: SparkSession, path: str) -> Samples:
        from tidemark.sources.files import read_data

        return read_data(spark, path)

    def step(self, df: DataFrame, what: str) -> Samples:
        return Samples(df, (*self.provenance, what))

    # -- relational operators --

    def filter(self, predicate: Column | Callable) -> Samples:
        """Rows for which a Column, or a Python function of a dict, is true."""
        if isinstance(predicate, Column):
            return self.step(self.df.filter(predicate), "filter")

        def run(batches):
            for pdf in batches:
                yield pdf[[bool(predicate(r)) for r in pdf.to_dict("records")]]

        return self.step(self.df.mapInPandas(run, SAMPLE), "filter")

    def map(self, change: dict[str, Column] | Callable) -> Samples:
        """Rows with columns replaced, or passed through a Python function from dict to dict."""
        if isinstance(change, dict):
            return self.step(self.df.withColumns(change), "map")
        names = SAMPLE.fieldNames()

        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame([change(r) for r in pdf.to_dict("records")], columns=names)

        return self.step(self.df.mapInPandas(run, SAMPLE), "map")

    def sample(self, n: int, seed: int = 42) -> Samples:
        """``n`` rows (or all) by the order of a seeded hash; the same ones on every run."""
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))
        return self.step(self.df.orderBy(key, "id", "_ord").limit(max(0, n)), f"sample {n}")

    def head(self, n: int = 10) -> Samples:
        return self.step(self.df.orderBy("_ord").limit(max(0, n)), f"head {n}")

    def tail(self, n: int = 10) -> Samples:
        """The last ``n`` rows; none for 0."""
        return self.step(self.df.orderBy(F.desc("_ord")).limit(max(0, n)), f"tail {n}")

    def concat(self, other: Samples) -> Samples:
        """All rows of both, this frame's first, duplicates included."""
        after = self.df.agg((F.coalesce(F.max("_ord"), F.lit(-1)) + 1).alias("_n"))
        low = other.df.agg(F.coalesce(F.min("_ord"), F.lit(0)).alias("_low"))
        moved = other.df.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(low))  # one row each
        moved = moved.withColumn("_ord", F.col("_ord") - F.col("_low") + F.col("_n")).drop("_n", "_low")
        return self.step(self.df.unionByName(moved), "concat")

    def diff(self, other: Samples) -> Samples:
        """Rows whose id the other frame doesn't have."""
        return self.step(self.df.join(other.df.select("id").distinct(), "id", "left_anti").select(*self.df.columns), "diff")

    def renumber(self, *order: Column) -> Samples:
        """``_ord`` anew, by ``order``."""
        from tidemark.schema import reorder

        return Samples(reorder(self.df, *order).select(*self.df.columns), self.provenance)

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[dict]:
        for r in self.df.orderBy("_ord").toLocalIterator():
            yield r.asDict(recursive=True)

    def __getitem__(self, at: int | slice) -> dict | Samples:
        """A row, or the rows of a slice, by dense position. Only a few rows near either end are sorted by every task for
        the driver; elsewhere the place is found by counting."""
        if isinstance(at, slice):
            if at.step not in (None, 1):
                raise ValueError("slices have a step of 1")
            lo, hi, _ = at.indices(len(self))
            what = f"slice {lo}:{hi}"
            if hi <= lo or hi <= NEAR:
                ranked = self.df.orderBy("_ord").limit(hi)
                return self.step(ranked.orderBy(F.desc("_ord")).limit(max(0, hi - lo)), what)
            (first, before), (last, _) = self._places(lo, hi - 1)
            return self.step(self.df.where(F.col("_ord").between(first, last)).orderBy("_ord", "id").offset(lo - before).limit(hi - lo), what)
        if 0 <= at < NEAR:
            rows = self.df.orderBy("_ord").offset(at).limit(1).collect()
        elif -NEAR <= at < 0:
            rows = self.df.orderBy(F.desc("_ord")).offset(-at - 1).limit(1).collect()
        else:
            n = len(self)
            if not -n <= at < n:
                raise IndexError(at)
            ((found, before),) = self._places(at % n)
            rows = self.df.where(F.col("_ord") == found).orderBy("id").offset(at % n - before).limit(1).collect()
        if not rows:
            raise IndexError(at)
        return rows[0].asDict(recursive=True)

    def _places(self, *positions: int) -> list[tuple[int, int]]:
        """(``_ord``, number of rows with a lesser one) at each dense position, from counts in ever narrower ranges."""
        from tidemark.plans.storage import stored

        ords, found = stored(self.df.select("_ord"), "places"), []
        for at in positions:
            (lo, hi), before = ords.agg(F.min("_ord"), F.max("_ord")).first(), 0
            while lo < hi:
                part = F.expr(f"(_ord - ({lo}L)) div {(hi - lo) // 1000 + 1}L")
                counts = ords.where(F.col("_ord").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("_ord").alias("lo"), F.max("_ord").alias("hi")).collect()
                for r in sorted(counts, key=lambda r: r.lo):
                    lo, hi = r.lo, r.hi
                    if before + r.n > at:
                        break
                    before += r.n
            found.append((lo, before))
        return found

    def to_list(self, most: int = 1_000_000) -> list[dict]:
        """Rows as dicts, in order; refuses more than ``most``."""
        rows = self.df.orderBy("_ord").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows; write them instead")
        return [r.asDict(recursive=True) for r in rows]

    # -- statistics --

    def describe(self) -> dict:
        row = describe(self.df).first()
        if not row["count"]:
            return {"count": 0}
        cats = {r.category: r.n for r in category_share(self.df).toLocalIterator()}
        side = lambda k: {"min": row[f"{k}_min"], "max": row[f"{k}_max"], "mean": row[f"{k}_mean"]}
        return {"count": row["count"], "categories": cats, "instruction_length": side("instruction"), "output_length": side("output")}

    def compute_metrics(self, metrics: list) -> dict:
        """Metrics, each with ``name`` and ``aggregate()`` (a Column) or ``compute(samples)``; the Columns share one pass."""
        native = {m.name: m.aggregate() for m in metrics if hasattr(m, "aggregate")}
        if native:
            self._metrics |= self.df.agg(*[c.alias(k) for k, c in native.items()]).first().asDict()
        self._metrics |= {m.name: m.compute(self) for m in metrics if not hasattr(m, "aggregate")}
        return dict(self._metrics)

    @property
    def metrics(self) -> dict:
        return dict(self._metrics)

    def plot_distribution(self, field: str = "category", bins: int = 50) -> list[dict]:
        """What a plot of a field needs: category counts, or a histogram of a text's lengths."""
        if field == "category":
            return [r.asDict() for r in category_share(self.df).toLocalIterator()]
        return [r.asDict() for r in length_histogram(self.df, field, bins).orderBy("bucket").collect()]

    def show(self, n: int = 20, width: int = 100) -> str:
        lines = [f"{r['id']} | {r['category']} | {r['instruction'][:width]} | {r['output'][:width]}" for r in self.head(n).to_list()]
        text = "\n".join(lines)
        print(text)
        return text

    def _repr_html_(self) -> str:
        cell = lambda s: f"<td>{html.escape(s[:100])}</td>"
        rows = "".join("<tr>" + "".join(cell(r[k] or "") for k in ("id", "category", "instruction", "output")) + "</tr>" for r in self.head(20).to_list())
        return f"<table><tr><th>id</th><th>category</th><th>instruction</th><th>output</th></tr>{rows}</table>"

    def __repr__(self) -> str:
        return f"Samples({' -> '.join(self.provenance) or 'new'})"


def describe(df: DataFrame) -> DataFrame:
    """One row: count, and least, greatest and mean length of both texts."""
    out = [F.count("*").alias("count")]
    for k in ("instruction", "output"):
        n = F.length(k)
        out += [F.min(n).cast("long").alias(f"{k}_min"), F.max(n).cast("long").alias(f"{k}_max"), F.avg(n).alias(f"{k}_mean")]
    return df.agg(*out)


def category_share(df: DataFrame) -> DataFrame:
    """(category, n, share) in falling order of n; the window is over the few categories."""
    counted = df.groupBy("category").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "category")


def length_histogram(df: DataFrame, field: str, bins: int = 50) -> DataFrame:
    """(bucket, n): equal ranges of a text's length between the least and the greatest, numbered from 0."""
    lengths = df.select(F.length(field).alias("n"))
    ends = lengths.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("n") - F.col("lo")) / width)))
    return lengths.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
