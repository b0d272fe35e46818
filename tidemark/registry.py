"""Names of operators, metrics, language models and embeddings. Everything that ships is registered on import."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    KINDS = ("operators", "metrics", "llms", "embeddings")

    def __init__(self) -> None:
        self._found: dict[str, dict[str, Any]] = {k: {} for k in self.KINDS}

    def register(self, kind: str, name: str, thing: Any = None) -> Any:
        """Registers ``thing``, or returns a decorator that does."""
        if kind not in self._found:
            raise KeyError(f"no such kind: {kind}; there are {', '.join(self.KINDS)}")
        if thing is None:
            return lambda x: self.register(kind, name, x)
        self._found[kind][name] = thing
        return thing

    def get(self, kind: str, name: str) -> Any:
        if name not in self._found[kind]:
            raise KeyError(f"{kind[:-1]} '{name}' not found; there are {', '.join(sorted(self._found[kind]))}")
        return self._found[kind][name]

    def list(self, kind: str) -> list[str]:
        return sorted(self._found[kind])

    def create(self, kind: str, name: str, **params: Any) -> Any:
        return self.get(kind, name)(**params)


registry = Registry()


def register_operator(name: str) -> Callable:
    return registry.register("operators", name)


def register_metric(name: str) -> Callable:
    return registry.register("metrics", name)


def register_llm(name: str) -> Callable:
    return registry.register("llms", name)


def register_embedding(name: str) -> Callable:
    return registry.register("embeddings", name)
