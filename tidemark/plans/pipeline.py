"""Pipelines: stages with a written checkpoint after each, results and reports."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tidemark.frame import Samples
from tidemark.plans.config import PipelineConfig, load_config
from tidemark.plans.stages import Stage, get_stage_class
from tidemark.plans.storage import ship
from tidemark.registry import registry
from tidemark.sources.local import exists, load_json, names, remove, save_json


class Checkpointer:
    """A Parquet folder and a file of facts for each stage. Reading one back also cuts the lineage."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _facts(self, stage: str) -> str:
        return f"{self.folder}/{stage}.meta.json"

    def save(self, stage: str, samples: Samples, after=None) -> Samples:
        """Writes and reads back; ``after`` gives the stage's metrics once the job has run."""
        path = f"{self.folder}/{stage}.parquet"
        samples.df.write.mode("overwrite").parquet(path)
        spark = samples.df.sparkSession
        back = Samples(spark.read.schema(samples.df.schema).parquet(path), samples.provenance)
        facts = dict(stage=stage, sample_count=back.df.count(), provenance=list(samples.provenance), metrics=after() if after else {}, timestamp=time.time())
        save_json(self._facts(stage), facts)
        return back

    def facts(self, stage: str) -> dict:
        return load_json(self._facts(stage))

    def load(self, spark: SparkSession, stage: str) -> Samples:
        if not self.exists(stage):
            raise FileNotFoundError(f"no checkpoint of {stage} in {self.folder}")
        facts = self.facts(stage)
        return Samples(spark.read.parquet(f"{self.folder}/{stage}.parquet"), (*facts["provenance"], f"loaded from checkpoint {stage}"))

    def exists(self, stage: str) -> bool:
        return exists(self._facts(stage))

    def list_checkpoints(self) -> list[str]:
        return [x[: -len(".meta.json")] for x in names(self.folder) if x.endswith(".meta.json")]

    def clear(self) -> None:
        for stage in self.list_checkpoints():
            remove(self._facts(stage))
            remove(f"{self.folder}/{stage}.parquet")


@dataclass
class PipelineResult:
    data: Samples
    stages: list[dict] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    elapsed: float = 0.0

    def report(self) -> str:
        lines = [f"{'stage':<28}{'in':>10}{'out':>10}{'seconds':>10}"]
        lines += [f"{s['stage']:<28}{s['in']:>10}{s['out']:>10}{s['seconds']:>10.2f}" for s in self.stages]
        text = "\n".join([*lines, f"total {self.elapsed:.2f} s"])
        print(text)
        return text

    def save(self, path: str) -> None:
        save_json(path, dict(stages=self.stages, metrics=self.metrics, elapsed=self.elapsed, provenance=list(self.data.provenance)))


class Pipeline:
    """Runs stages in order; each result is written once and read back, so a model isn't asked twice."""

    def __init__(self, config: PipelineConfig | None = None, stages: list[Stage] | None = None, checkpoint_dir: str | None = None) -> None:
        self.config = config or PipelineConfig(checkpoint_enabled=checkpoint_dir is not None)
        self.stages = list(stages or [])
        if config is not None and not stages:
            self.stages = [self._stage(s) for s in config.stages]
        folder = checkpoint_dir or (self.config.checkpoint_dir if self.config.checkpoint_enabled else None)
        self.checkpointer = Checkpointer(folder) if folder else None

    def _stage(self, conf) -> Stage:
        """A stage with its operators; thresholds, embedding and model settings of the pipeline are defaults for theirs."""
        made, c = [], self.config
        llm = {"llm_backend": c.llm.backend, "llm_model": c.llm.model, "temperature": c.llm.temperature, "max_tokens": c.llm.max_tokens, "base_url": c.llm.base_url, "api_key": c.llm.api_key}
        if c.llm.fallback_backend:
            llm["fallback"] = c.llm.fallback_backend
        emb = {"embedding_backend": c.embedding.backend, "embedding_model": c.embedding.model}
        own = {
            "semantic_dedup": {"threshold": c.dedup_threshold, **emb}, "quality_filter": {"threshold": c.quality_threshold},
            "diversity_filter": emb, "knowledge_filter": {"top_k": c.target_samples, **emb}, "llm_synthesis": llm, "reasoning_chain": llm,
        }
        for o in conf.operators:
            params = own.get(o.name, {}) | o.params
            kind = registry.get("operators", o.name)
            if o.enabled:
                made.append(kind(**params))
        return get_stage_class(conf.name)(operators=made, llm=llm, dedup_threshold=c.dedup_threshold, quality_threshold=c.quality_threshold, **conf.extra)

    def add_stage(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    def run(self, samples: Samples, resume_from: str | None = None) -> PipelineResult:
        begin, todo = time.time(), list(self.stages)
        if resume_from is not None:
            names = [s.name for s in todo]
            if resume_from not in names or self.checkpointer is None or not self.checkpointer.exists(resume_from):
                raise ValueError(f"there is no checkpoint of a stage '{resume_from}' of this pipeline")
            samples = self.checkpointer.load(samples.df.sparkSession, resume_from)
            todo = todo[names.index(resume_from) + 1 :]
        done = PipelineResult(samples)
        n = samples.df.count()
        for stage in todo:
            if not n:
                raise ValueError(f"nothing goes into stage {stage.name}")
            at = time.time()
            samples = self._run(stage, samples, done)
            m = samples.df.count()
            done.stages.append({"stage": stage.name, "in": n, "out": m, "seconds": time.time() - at})
            if not m:
                raise ValueError(f"nothing comes out of stage {stage.name}")
            n = m
        done.data, done.elapsed = samples, time.time() - begin
        return done

    def _run(self, stage: Stage, samples: Samples, done: PipelineResult) -> Samples:
        out = stage.process(samples)

        def after() -> dict:
            stage.finished()
            done.metrics[stage.name] = stage.metrics()
            return done.metrics[stage.name]

        if self.checkpointer:
            return self.checkpointer.save(stage.name, out, after)
        from tidemark.plans.storage import stored

        back = Samples(stored(out.df, stage.name), out.provenance)
        after()
        return back

    def run_stage(self, name: str, samples: Samples) -> Samples:
        """One stage of this pipeline, or one by name with its defaults; lazy and without a checkpoint."""
        stage = next((s for s in self.stages if s.name == name), None) or get_stage_class(name)()
        return stage.process(samples)

    def status(self) -> dict:
        saved = self.checkpointer.list_checkpoints() if self.checkpointer else []
        return dict(name=self.config.name, checkpoints=saved, stages=[s.name for s in self.stages])


class Tidemark:
    """One place for loading, running and the registry."""

    def __init__(self, spark: SparkSession, config: str | PipelineConfig | None = None) -> None:
        ship(spark)
        self.spark = spark
        self.config = load_config(config) if isinstance(config, str) else config
        self.registry = registry

    def load(self, path: str) -> Samples:
        from tidemark.sources.files import read_data

        return read_data(self.spark, path)

    @property
    def pipeline(self) -> Pipeline:
        if self.config is None:
            raise ValueError("a pipeline needs a configuration")
        return Pipeline(self.config)

    def run_pipeline(self, samples: Samples, resume_from: str | None = None) -> PipelineResult:
        return self.pipeline.run(samples, resume_from)

    def run_stage(self, name: str, samples: Samples) -> Samples:
        return (self.pipeline if self.config else Pipeline()).run_stage(name, samples)
