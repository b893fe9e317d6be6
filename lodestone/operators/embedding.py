"""Vectors of texts: the provider interface, its batches, and a deterministic stand-in."""

from __future__ import annotations

import hashlib
import math
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas as S
from lodestone.functions.vectors import INCREMENT, MASK, MULTIPLIER, hash_vector


class EmbeddingProvider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """The vectors of ``functions.vectors.hash_vector``, for queries on the driver and for tests."""

    def __init__(self, dimension: int = S.VECTOR_SIZE):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            state = int(hashlib.md5(t.encode()).hexdigest()[-8:], 16) & MASK
            v = []
            for _ in range(self.dimension):
                state = (state * MULTIPLIER + INCREMENT) & MASK
                v.append(state / MASK - 0.5)
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def embedded(rows: DataFrame, text: Column, provider: EmbeddingProvider, batch: int = S.EMBED_BATCH) -> DataFrame:
    """``rows`` with ``embedding``. A failing provider fails the job: a collection without vectors is of no use.

    The hash provider runs as an expression in the JVM; others are called with
    at most ``batch`` texts at a time, in order, inside the partitions.
    """
    if isinstance(provider, HashProvider):
        return rows.withColumn("embedding", hash_vector(text, provider.dimension).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        some = texts.fillna("").tolist()
        return pd.Series([v for i in range(0, len(some), batch) for v in provider.embed(some[i : i + batch])])

    return rows.withColumn("embedding", embed(text))
