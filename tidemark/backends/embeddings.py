"""Embedding backends: a deterministic hashing one, and adapters for local models and HTTP services."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.registry import register_embedding, registry


class EmbeddingBackend:
    """``embed`` gives an (n, dimension) matrix for n texts."""

    dimension = 0

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def embed_single(self, text: str) -> np.ndarray:
        return self.embed([text])[0]

    def embed_batched(self, texts: list[str], batch_size: int = 100) -> np.ndarray:
        parts = [self.embed(texts[i : i + batch_size]) for i in range(0, len(texts), batch_size)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimension))

    def similarity(self, a: str, b: str) -> float:
        x, y = self.embed([a, b])
        return float(x @ y / ((np.linalg.norm(x) + 1e-9) * (np.linalg.norm(y) + 1e-9)))

    def health_check(self) -> bool:
        try:
            found = self.embed(["ping"])
        except Exception:
            return False
        return len(found) == 1


@register_embedding("hashing")
class HashingEmbedding(EmbeddingBackend):
    """Unit vectors of signed hashes of words and character trigrams; needs no model and never changes."""

    def __init__(self, model: str | None = None, dimension: int = 128, **extra) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            low = (text or "").lower()
            for g in [*low.split(), *(low[i : i + 3] for i in range(max(0, len(low) - 2)))]:
                h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


@register_embedding("sentence_transformers")
class SentenceTransformersEmbedding(EmbeddingBackend):
    """A local model of the sentence-transformers library, if it is installed."""

    def __init__(self, model: str | None = None, **extra) -> None:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the sentence_transformers backend needs that library") from e
        self.model = SentenceTransformer(model or "all-MiniLM-L6-v2")
        self.dimension = self.model.get_sentence_embedding_dimension()

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts))


@register_embedding("openai")
class OpenAIEmbedding(EmbeddingBackend):
    """A service with OpenAI's embeddings interface."""

    def __init__(self, model: str | None = None, timeout: float = 60, base_url: str | None = None, api_key: str | None = None, **extra) -> None:
        self.model, self.key, self.timeout = model or "text-embedding-3-small", api_key, timeout
        self.url = (base_url or "https://api.openai.com/v1").rstrip("/")
        self.dimension = 3072 if self.model.endswith("large") else 1536

    def embed(self, texts: list[str]) -> np.ndarray:
        body = json.dumps(dict(input=texts, model=self.model)).encode()
        req = urllib.request.Request(f"{self.url}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(req, timeout=self.timeout) as r:
            got = {d["index"]: d["embedding"] for d in json.load(r)["data"]}
        return np.array([got[i] for i in range(len(texts))])


for alias, name in (("st", "sentence_transformers"), ("huggingface", "sentence_transformers"), ("hf", "sentence_transformers")):
    registry.register("embeddings", alias, registry.get("embeddings", name))


def create_embedding(backend: str = "hashing", model: str | None = None, **params) -> EmbeddingBackend:
    return registry.create("embeddings", backend, model=model, **params)


get_embedding = create_embedding


def embed_column(df: DataFrame, text: str, out: str, backend: Callable[[], EmbeddingBackend], batch_size: int = 100) -> DataFrame:
    """``df`` with the vectors of a text column; the backend is made once in each worker process, not for each row."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = backend()
        for s in batches:
            yield pd.Series(list(model.embed_batched(s.fillna("").tolist(), batch_size)), dtype=object)

    return df.withColumn(out, embed(F.col(text)))


def find_similar(query: DataFrame, corpus: DataFrame, top_k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, match, sim, rank): the nearest ``top_k`` rows of ``corpus`` for each row of ``query``, by cosine.

    Exact, and so quadratic at every size: blocks of both sides meet in matrix products. Ties go to the lesser match.
    """
    from pyspark.sql import Window

    from tidemark.operators.dedup import nearest

    found = nearest(query.select(F.col(key).alias("l"), F.col(vector).alias("vec")), corpus.select(F.col(key).alias("r"), F.col(vector).alias("vec")), top_k, 6, other=True)
    w = Window.partitionBy("query").orderBy(F.desc("sim"), "match")
    return found.select(F.col("l").alias("query"), F.col("r").alias("match"), "sim").withColumn("rank", F.row_number().over(w))
