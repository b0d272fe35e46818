"""Operators: from a frame of samples to a frame of samples, with metrics observed while it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.frame import Samples
from tidemark.registry import registry

Watch = Callable[..., DataFrame]


def unwatched(df: DataFrame, place: str, **more: Column) -> DataFrame:
    return df


class Operator:
    """Subclasses give ``apply(df, watch)``; ``watch(df, place, name=aggregate)`` marks where rows are counted.

    A subclass with a ``name`` of its own is registered under it. ``defaults`` are its parameters, in order; values are
    attributes of the operator. Parameters that it doesn't know are kept aside, as configurations may have more.
    """

    name = "operator"
    defaults: dict = {}

    def __init_subclass__(cls) -> None:
        if "name" in cls.__dict__:
            registry.register("operators", cls.name, cls)

    def __init__(self, *values, **more) -> None:
        given = dict(zip(self.defaults, values))
        if len(values) > len(self.defaults) or given.keys() & more.keys():
            raise TypeError(f"{self.name} takes {', '.join(self.defaults)}")
        given |= more
        self.params = {k: given.pop(k, v) for k, v in self.defaults.items()}
        self.extra = given
        self.__dict__.update(self.params)
        self._seen: dict[str, Observation] = {}
        self._out: DataFrame | None = None
        self.ran = False
        self.prepare()

    def prepare(self) -> None:
        """For what a subclass makes of its parameters."""

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        raise NotImplementedError

    def watched(self, df: DataFrame) -> DataFrame:
        """``apply`` with counts taken along in the same job that uses the result."""
        self._seen, self.ran = {}, False

        def watch(frame: DataFrame, place: str, **more: Column) -> DataFrame:
            self._seen[place] = Observation()
            return frame.observe(self._seen[place], F.count("*").alias("count"), *[c.alias(k) for k, c in more.items()])

        self._out = self.apply(df, watch)
        return self._out

    def __call__(self, samples: Samples) -> Samples:
        return samples.step(self.watched(samples.df), repr(self))

    @property
    def metrics(self) -> dict:
        """What was observed; runs the operator if nothing has yet."""
        if self._out is None:
            return {}
        if not self.ran:
            self._out.write.format("noop").mode("overwrite").save()
            self.ran = True
        seen = {k: o.get for k, o in self._seen.items()}
        return self.measured(seen.get("in", {}), seen.get("out", {}))

    def measured(self, into: dict, out: dict) -> dict:
        n, m = into.get("count", 0), out.get("count", 0)
        found = {"input_count": n, "output_count": m, "filtered_count": n - m, "filter_rate": (n - m) / n if n else 0.0}
        return found | {k: v for k, v in (into | out).items() if k != "count"}

    def explain(self, df: DataFrame | None = None) -> str:
        """What the operator does, and with a frame also Spark's plan for it."""
        text = f"{self!r}: {(self.__doc__ or '').strip().splitlines()[0]}"
        if df is not None:
            text += "\n" + self.apply(df)._jdf.queryExecution().explainString(self.apply(df).sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return text

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.params.items())})"


class FilterOperator(Operator):
    """Keeps the rows for which ``keep()``, a Column, is true."""

    def keep(self) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        return watch(watch(df, "in").filter(self.keep()), "out")


class TransformOperator(Operator):
    """Replaces columns by those of ``change()``, a dict of Columns."""

    def change(self) -> dict[str, Column]:
        raise NotImplementedError

    def apply(self, df: DataFrame, watch: Watch = unwatched) -> DataFrame:
        return watch(watch(df, "in").withColumns(self.change()), "out")

    def measured(self, into: dict, out: dict) -> dict:
        return {"input_count": into.get("count", 0), "output_count": out.get("count", 0)}
