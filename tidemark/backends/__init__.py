"""Pluggable language-model and embedding backends. All are registered on import; clients are made inside workers."""

from tidemark.backends import embeddings, llms

__all__ = ["embeddings", "llms"]
