"""Embedders: a model name, a dimension and a batch function, run in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic stand-in for a model: signed word hashes, scaled to length 1."""

    model = "hashing-v1"

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


class LazyEmbedder:
    """An embedder that a worker makes at its first batch; only the factory travels to the workers."""

    def __init__(self, model: str, dimension: int, factory: Callable[[], Embedder]):
        self.model, self.dimension, self.factory = model, dimension, factory
        self._made: Embedder | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_made": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        if self._made is None:
            self._made = self.factory()
        return self._made.embed(texts)


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", into: str = "embedding", error: str = "embedding_error") -> DataFrame:
    """df with an embedding of each text, or null and why there is none.

    The embedder is made ready once in each worker, at its first batch; where a batch fails, its texts are tried one by one.
    """
    dimension = embedder.dimension

    def tried(texts: list[str]) -> list[tuple]:
        try:
            got = [list(e) for e in embedder.embed(texts)]
            if len(got) != len(texts) or any(len(e) != dimension for e in got):
                raise ValueError("the embedder gave another number or size of embeddings")
            return [(e, None) for e in got]
        except Exception as x:  # whatever a model raises is its text's failure
            return [(None, f"{type(x).__name__}: {x}")] if len(texts) == 1 else [tried([t])[0] for t in texts]

    @F.pandas_udf("embedding array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(tried(texts.tolist()) if len(texts) else [], columns=["embedding", "error"], dtype=object)

    return df.withColumn("__got", run(F.col(text))).withColumns({into: F.col("__got.embedding"), error: F.col("__got.error")}).drop("__got")
