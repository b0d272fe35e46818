"""Stages: named sequences of operators with defaults of their own."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from tidemark.frame import Samples
from tidemark.operators.base import Operator
from tidemark.operators.dedup import ExactDedup, SemanticDedup
from tidemark.operators.diversity import DiversityFilter
from tidemark.operators.enrich import LLMSynthesis, ReasoningChainEnhancer
from tidemark.operators.filters import KnowledgeFilter, NoiseDetector, QualityFilter
from tidemark.plans.report import write_reports


class Stage:
    """Applies its operators in turn. Metrics are kept by place and name, so a repeated operator has its own."""

    name = "stage"

    def __init__(self, operators: Sequence[Operator] = (), **settings: Any) -> None:
        self.settings = settings
        self.operators = list(operators) or self.defaults()

    def defaults(self) -> list[Operator]:
        return []

    def validate(self, samples: Samples) -> bool:
        return not samples.df.isEmpty()

    def process(self, samples: Samples) -> Samples:
        for op in self.operators:
            samples = op(samples)
        return samples

    def metrics(self) -> dict:
        """Of the last run; call it after the stage's result was written."""
        return {f"op_{i}_{op.name}": op.metrics for i, op in enumerate(self.operators)}

    def finished(self) -> None:
        """Says that an action ran, so that observed counts are there."""
        for op in self.operators:
            op.ran = True


class CurateStage(Stage):
    """Exact and similarity dedup, quality, and a varied subset; or an outside tool that does it, if there is one."""

    name = "s1_data_juicer"

    def defaults(self) -> list[Operator]:
        s = self.settings
        return [ExactDedup(), SemanticDedup(s.get("dedup_threshold", 0.95)), QualityFilter(s.get("quality_threshold", 0.8)), DiversityFilter(s.get("target_count", 1500))]

    def process(self, samples: Samples) -> Samples:
        tool = self.settings.get("external_command")
        if tool and shutil.which(tool[0]):
            found = self._outside(samples, tool)
            if found is not None:
                return found
        return super().process(samples)

    def _outside(self, samples: Samples, tool: list[str]) -> Samples | None:
        """Through files; None when the tool fails, takes too long or writes nothing."""
        from tidemark.sources.files import read_data, write_sft

        folder = tempfile.mkdtemp(prefix="tidemark-tool-")
        into, out = os.path.join(folder, "in.json"), os.path.join(folder, "out.jsonl")
        write_sft(samples.df, into)
        try:
            done = subprocess.run([*tool, into, out], timeout=self.settings.get("timeout", 3600), capture_output=True, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        if done.returncode or not os.path.exists(out):
            return None
        return samples.step(read_data(samples.df.sparkSession, out).df, f"outside tool {tool[0]}")


class KnowledgeStage(Stage):
    """Twice the wanted samples by knowledge, weak ones rewritten, then the wanted ones."""

    name = "s2_knowledge_filter"

    def defaults(self) -> list[Operator]:
        s = self.settings
        k = s.get("top_k", 1000)
        middle = [LLMSynthesis(**s.get("llm", {}), synthesis_style="textbook", target_samples="low_knowledge", quality_threshold=0.5)] if s.get("use_llm_synthesis", True) else []
        return [KnowledgeFilter(2 * k), *middle, KnowledgeFilter(k)]


class ReasoningStage(Stage):
    """Reasoning samples answered step by step, then noise removed."""

    name = "s3_reasoning_enhance"

    def defaults(self) -> list[Operator]:
        s = self.settings
        return [ReasoningChainEnhancer(**s.get("llm", {}), chain_style=s.get("chain_style", "step_by_step")), NoiseDetector()]


class EvaluateStage(Stage):
    """Metrics and reports; the data passes through."""

    name = "s4_sandbox_eval"

    found: dict = {}

    def __init__(self, operators: Sequence[Operator] = (), **settings: Any) -> None:
        super().__init__((), **settings)  # it has no use for operators

    def process(self, samples: Samples) -> Samples:
        s = self.settings
        self.found = write_reports(samples.df, s.get("report_path", "reports/quality_report.html"), s.get("metrics_path", "reports/metrics.json"))
        return samples.step(samples.df, "evaluated")

    def metrics(self) -> dict:
        return {"dataset": self.found}


STAGES: dict[str, type[Stage]] = {c.name: c for c in (CurateStage, KnowledgeStage, ReasoningStage, EvaluateStage)}
STAGES |= {"data_juicer": CurateStage, "knowledge_filter": KnowledgeStage, "reasoning_enhance": ReasoningStage, "sandbox_eval": EvaluateStage}


def get_stage_class(name: str) -> type[Stage]:
    if name not in STAGES:
        raise KeyError(f"stage '{name}' not found; there are {', '.join(STAGES)}")
    return STAGES[name]


def chain(df: DataFrame, operators: list[Operator]) -> DataFrame:
    """Operators in turn as one lazy plan."""
    for op in operators:
        df = op.apply(df)
    return df
