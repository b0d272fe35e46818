"""Pipeline configuration: dataclasses with checked ranges, read from YAML or JSON. Unknown keys are kept."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tidemark.sources.local import load_json, save_json, save_text


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class _Loose:
    """Takes any keys; those that aren't fields are in ``extra``."""

    @classmethod
    def of(cls, data: Any):
        if isinstance(data, cls):
            return data
        if not isinstance(data, dict):
            raise ValueError(f"{cls.__name__} needs a mapping, not {type(data).__name__}")
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in data.items() if k in known}, extra={k: v for k, v in data.items() if k not in known})

    def dump(self) -> dict:
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "extra":
                out |= v
            elif isinstance(v, _Loose):
                out[f.name] = v.dump()
            elif isinstance(v, list):
                out[f.name] = [x.dump() if isinstance(x, _Loose) else x for x in v]
            elif v is not None:
                out[f.name] = v
        return out


@dataclass
class OperatorConfig(_Loose):
    name: str
    enabled: bool = True
    params: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)


@dataclass
class StageConfig(_Loose):
    """A stage: its operators, checks, and settings of its own such as ``top_k`` or ``report_path`` in ``extra``."""

    name: str
    operators: list = field(default_factory=list)
    input_validation: bool = True
    output_validation: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.operators = [OperatorConfig.of(o) for o in self.operators or []]
        for k in ("top_k", "max_steps", "sample_size"):
            _check(self.extra.get(k) is None or self.extra[k] > 0, f"{k} must be positive")
        style = self.extra.get("chain_style")
        _check(style in (None, "step_by_step", "cot", "tree_of_thought"), f"unknown chain_style {style}")


@dataclass
class LLMConfig(_Loose):
    backend: str = "ollama"
    model: str = "phi3:medium"
    temperature: float = 0.3
    max_tokens: int = 2048
    fallback_backend: str | None = None
    api_key: str | None = None
    base_url: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        _check(0 <= self.temperature <= 2, "temperature must be between 0 and 2")
        _check(self.max_tokens > 0, "max_tokens must be positive")


@dataclass
class EmbeddingConfig(_Loose):
    backend: str = "hashing"
    model: str | None = None
    batch_size: int = 32
    api_key: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        _check(self.batch_size > 0, "batch_size must be positive")


@dataclass
class PipelineConfig(_Loose):
    name: str = "pipeline"
    version: str = "1.0.0"
    stages: list = field(default_factory=list)
    checkpoint_enabled: bool = True
    checkpoint_dir: str = ".checkpoints"
    parallel_workers: int = 4
    input_format: str = "jsonl"
    output_format: str = "jsonl"
    dedup_threshold: float = 0.95
    quality_threshold: float = 0.8
    target_samples: int = 1000
    llm: Any = field(default_factory=dict)
    embedding: Any = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stages = [StageConfig.of(s) for s in self.stages or []]
        self.llm, self.embedding = LLMConfig.of(self.llm or {}), EmbeddingConfig.of(self.embedding or {})
        for k in ("dedup_threshold", "quality_threshold"):
            _check(0 <= getattr(self, k) <= 1, f"{k} must be between 0 and 1")
        for k in ("parallel_workers", "target_samples"):
            _check(getattr(self, k) > 0, f"{k} must be positive")
        _check(self.input_format in ("jsonl", "parquet", "csv"), f"unknown input_format {self.input_format}")
        _check(self.output_format in ("jsonl", "parquet"), f"unknown output_format {self.output_format}")


def expand(data: Any) -> Any:
    """``$VAR`` and ``${VAR}`` in all texts, at any depth."""
    match data:
        case str():
            return os.path.expandvars(data)
        case list():
            return [expand(x) for x in data]
        case dict():
            return {k: expand(v) for k, v in data.items()}
    return data


def merge(*configs: dict) -> dict:
    """Mappings merged at any depth, later ones over earlier ones; the inputs stay as they are."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def _kind(path: str) -> str:
    kind = os.path.splitext(path)[1].lower()
    if kind not in (".yaml", ".yml", ".json"):
        raise ValueError(f"unknown configuration type '{kind}'; there are .yaml, .yml and .json")
    return kind


def load_config(path: str) -> PipelineConfig:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = _kind(path)
    if kind == ".json":
        data = load_json(path)
    else:
        import yaml

        data = yaml.safe_load(Path(path).read_text("utf-8"))
    return PipelineConfig.of(expand(data or {}))


def save_config(config: PipelineConfig, path: str) -> None:
    kind = _kind(path)
    if kind == ".json":
        save_json(path, config.dump())
    else:
        import yaml

        save_text(path, yaml.safe_dump(config.dump(), allow_unicode=True, sort_keys=False))
