"""What turns text into vectors or scores: pluggable providers, run in Arrow batches; and named dimensions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.store import missing_vectors


class Provider(Protocol):
    """Makes vectors of texts. It is sent to the executors, so it must pickle; heavy parts are best loaded on first use."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashProvider:
    """Deterministic unit vectors, Gaussian from a seed that the text's SHA-256 gives: equal texts, equal vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.stack([np.random.RandomState(int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big")).randn(self.dim) for t in texts]) if texts else np.zeros((0, self.dim))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class NullProvider:
    """No vectors: every row stays without one."""

    dim = 0

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), 0))


def provider(name: str = "auto", **settings) -> Provider:
    """A provider by name: hash, null, or auto (hash)."""
    if name == "null":
        return NullProvider()
    if name in ("hash", "auto"):
        return HashProvider(**settings)
    raise ValueError(f"no such provider: {name}")


def embed(rows: DataFrame, by: Provider, text: str = "value") -> DataFrame:
    """Rows with column v: the vector of each text, batch by batch; null where the text is null or the provider has none."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        at = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        if by.dim and at:
            for i, v in zip(at, by.embed([texts.iat[i] for i in at])):
                out[i] = v.tolist()
        return pd.Series(out, dtype=object)

    return rows.withColumn("v", vectors(F.col(text)))


def re_embedded(rows: DataFrame, vectors: DataFrame, by: Provider) -> DataFrame:
    """The vectors (path, v) of all rows: those that are stored in the right dimension, and new ones for the rest;
    vectors without a row are gone. Only texts that lack a vector are embedded."""
    todo = missing_vectors(rows, vectors, by.dim)
    kept = vectors.where(F.size("v") == by.dim).select("path", "v").join(todo.where("action = 'drop'").select("path"), "path", "left_anti")
    new = embed(rows.join(todo.where("action = 'embed'").select("path"), "path", "left_semi"), by)
    return kept.union(new.select("path", "v"))


class Reranker(Protocol):
    """Scores values for a query."""

    def __call__(self, query: str, values: list[str]) -> list[float]: ...


def word_overlap(query: str, values: list[str]) -> list[float]:
    """The share of the query's different words that a value has; what stands in for a cross encoder."""
    wanted = set(query.lower().split())
    return [len(wanted & set(v.lower().split())) / max(1, len(wanted)) for v in values]


def rerank(rows: DataFrame, query: str, scorer: Reranker, k: int = 10, text: str = "value") -> DataFrame:
    """The k rows that a scorer likes best; it reads the first 1,500 characters of each, as cross encoders do."""

    @F.pandas_udf("double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(scorer(query, p.fillna("").tolist()), dtype=float)

    return rows.withColumn("rerank", told(F.substring(F.col(text), 1, 1500))).orderBy(F.desc("rerank"), "path").limit(k)


DIMENSIONS: dict[str, Callable[[Column, Column], Column]] = {}


def dimension(name: str, likeness: Callable[[Column, Column], Column]) -> None:
    """Registers a dimension by which rows can be alike, as an expression of two columns."""
    DIMENSIONS[name] = likeness


dimension("temporal", lambda a, b: F.exp(-F.abs(a - b) / 86400.0))
dimension("confidence", lambda a, b: 1 - F.abs(a - b))
dimension("trust", lambda a, b: 1 - F.abs(a - b))
dimension("relational", lambda a, _: 1 / (1 + a))


def likeness(parts: dict[str, tuple[Column, Column, float]]) -> Column:
    """Weighted mean over dimensions, from (a, b, weight) by name."""
    total = sum(w for _, _, w in parts.values())
    return sum((DIMENSIONS[n](a, b) * w for n, (a, b, w) in parts.items()), F.lit(0.0)) / total
