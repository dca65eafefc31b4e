"""Linear algebra and greedy choices on one group of vectors: numpy functions and how to apply them by group."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TILE = (1024, 4096)  # rows by rows of a matrix product
GROUPS = 64  # tasks for groups; not left to their bytes, as a group's work may grow faster


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n > 1e-12 else v


def compose(vectors: np.ndarray, weights: Sequence[float] | None = None, mode: str = "weighted_mean") -> np.ndarray:
    """One unit vector for many.

    weighted_mean; principal (first direction of the weighted, centred rows, on the mean's side); grassmann (ten steps of
    the mean on the sphere); attentive (rows that agree with the others weigh more). Without a length, the first row.
    """
    m = np.asarray(vectors, float)
    if not len(m):
        raise ValueError("nothing to compose")
    if len(m) == 1:
        return _unit(m[0])
    w = np.full(len(m), 1 / len(m)) if weights is None else np.asarray(weights, float) / (np.sum(weights) + 1e-12)
    mean = w @ m
    if mode == "weighted_mean":
        out = mean
    elif mode == "principal":
        apart = m - mean / len(m)
        side = np.linalg.eigh((apart * w[:, None]).T @ apart)[1][:, -1]
        out = side if side @ mean >= 0 else -side
    elif mode == "grassmann":
        out = m[0]
        for _ in range(10):
            c = np.clip(m @ out, -1, 1)
            across = m - c[:, None] * out
            size = np.linalg.norm(across, axis=1)
            use = (np.abs(c) <= 0.9999) & (size > 1e-10)
            pull = (w[use] * np.arccos(c[use]) / size[use]) @ across[use]
            far = float(np.linalg.norm(pull))
            if far < 1e-10:
                break
            out = out * math.cos(far) + pull * (math.sin(far) / far)
    elif mode == "attentive":
        heat = m @ m.sum(0) - np.einsum("ij,ij->i", m, m)  # likeness to all others, without the matrix of all pairs
        a = w * np.exp(heat - heat.max())
        out = (a / (a.sum() + 1e-12)) @ m
    else:
        raise ValueError(f"no such mode: {mode}")
    return _unit(out) if np.linalg.norm(out) >= 1e-12 else _unit(m[0])


def project(v: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` on the span of the basis rows, and the share of its energy that stays."""
    q = np.linalg.qr(np.asarray(basis, float).T)[0]
    p = q @ (q.T @ v)
    return p, float((p @ p) / (v @ v + 1e-12))


def complement(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """What of the query no row explains, at unit length (as it is where nothing is left)."""
    q = np.linalg.qr(np.asarray(vectors, float).T)[0]
    return _unit(query - q @ (q.T @ query))


def decompose(v: np.ndarray, axes: dict[str, np.ndarray]) -> dict[str, float]:
    """Share of each named axis in the squared cosines, 4 places."""
    part = {k: float(_unit(np.asarray(a, float)) @ v) ** 2 for k, a in axes.items()}
    total = sum(part.values())
    return {k: round(x / total, 4) if total > 1e-12 else 0.0 for k, x in part.items()}


def alignment(a: np.ndarray, b: np.ndarray, n: int = 5) -> float:
    """Mean cosine of the principal angles between two groups' leading subspaces, 4 places; 0 for fewer than two rows."""
    if len(a) < 2 or len(b) < 2:
        return 0.0
    k = min(n, len(a), len(b), a.shape[1])
    x, y = (np.linalg.svd(m - m.mean(0), full_matrices=False)[2][:k] for m in (np.asarray(a, float), np.asarray(b, float)))
    return round(float(np.clip(np.linalg.svd(x @ y.T, compute_uv=False), 0, 1).mean()), 4)


def mmr(scores: Sequence[float], vectors: Sequence[np.ndarray | None], k: int, lam: float = 0.7) -> list[int]:
    """Rows chosen one by one by relevance less their likeness to those chosen; rows without a vector come last."""
    have = [i for i, v in enumerate(vectors) if v is not None]
    if not have:
        return heapq.nlargest(k, range(len(scores)), key=lambda i: scores[i])
    m = np.stack([np.asarray(vectors[i], float) for i in have])
    rel, worst = np.array([scores[i] for i in have]), np.zeros(len(have))
    free, out = np.ones(len(have), bool), []
    for _ in range(min(k, len(have))):
        value = np.where(free, lam * rel - (1 - lam) * worst, -np.inf)
        best = int(np.argmax(value))
        if value[best] <= -1.0:  # nothing beats the floor: the first that is left
            best = int(np.flatnonzero(free)[0])
        free[best] = False
        sims = m @ m[best]
        worst = sims if not out else np.maximum(worst, sims)
        out.append(have[best])
    return out + [i for i in range(len(scores)) if vectors[i] is None][: k - len(out)]


def diverse(query: np.ndarray, vectors: np.ndarray, k: int = 10, diversity: float = 0.0) -> list[int]:
    """Search with diversity: a pool of three times k by similarity, then rows chosen against those chosen before."""
    sims = vectors @ query
    pool = np.argsort(-sims, kind="stable")[: min(3 * k, len(sims))]
    if diversity <= 0 or len(pool) <= k:
        return pool[:k].tolist()
    out = [int(pool[0])]
    left = [int(i) for i in pool[1:]]
    while left and len(out) < k:
        value = [(1 - diversity) * sims[i] - diversity * float(np.max(vectors[out] @ vectors[i])) for i in left]
        out.append(left.pop(int(np.argmax(value))))
    return out


def average_linkage(vectors: np.ndarray, threshold: float = 0.7) -> np.ndarray:
    """Agglomerative clusters by mean similarity.

    The mean similarity of two clusters is the product of their mean vectors, so no matrix of all rows is held. A merge
    never brings clusters nearer to others than both parts were, so all pairs that are each other's nearest merge in one
    round, as they would one by one; and what is near to none is done. Only clusters whose nearest merged look again,
    tile by tile.
    """
    n = len(vectors)
    means, size, label = np.array(vectors, float), np.ones(n), np.arange(n)
    near, best = np.full(n, -1), np.full(n, -np.inf)
    alive = todo = np.arange(n)
    while len(alive) > 1:
        for at in range(0, len(todo), TILE[0]):
            ids = todo[at : at + TILE[0]]
            near[ids], best[ids] = -1, -np.inf
            for to in range(0, len(alive), TILE[1]):
                others = alive[to : to + TILE[1]]
                sims = means[ids] @ means[others].T
                sims[ids[:, None] == others[None]] = -np.inf
                j = sims.argmax(axis=1)
                top = sims[np.arange(len(ids)), j]
                better = top > best[ids]
                near[ids[better]], best[ids[better]] = others[j[better]], top[better]
        alive = alive[best[alive] >= threshold]
        if not len(alive):
            break
        a = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(a):  # a ring of equal similarities
            a = alive[[int(np.argmax(best[alive]))]]
            b = near[a]
        else:
            b = near[a]
        a, b = np.minimum(a, b), np.maximum(a, b)
        means[a] = (means[a] * size[a, None] + means[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        label[b] = a
        gone, changed = np.zeros(n, bool), np.zeros(n, bool)
        gone[b], changed[a], changed[b] = True, True, True
        alive = alive[~gone[alive]]
        todo = alive[changed[alive] | changed[near[alive]]]
    while (label[label] != label).any():
        label = label[label]
    return label


def region(vectors: np.ndarray) -> dict[str, float]:
    """Radius, density, count, variance and local dimension of one cluster."""
    center = _unit(vectors.mean(0))
    far = float(np.arccos(np.clip(vectors @ center, -1, 1)).max())
    s = np.linalg.svd(vectors - vectors.mean(0), full_matrices=False)[1] if len(vectors) > 2 else np.zeros(0)
    s = s[s > 1e-10] ** 2
    dim = float(vectors.shape[1]) if len(vectors) < 3 else float(s.sum() ** 2 / ((s**2).sum() + 1e-12)) if len(s) else 0.0
    return {"n": len(vectors), "radius": far, "density": len(vectors) / (far + 1e-10), "variance": float(vectors.var(0).mean()), "dimension": dim}


def voids(vectors: np.ndarray, probes: int = 50, seed: int = 42, least: float = 0.3) -> np.ndarray:
    """Seeded random directions that no row is near to, either way."""
    if len(vectors) < 3:
        return np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    p = np.random.RandomState(seed).randn(probes, vectors.shape[1])
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    return p[np.abs(vectors @ p.T).max(axis=0) < least]


def geodesic(vectors: np.ndarray, a: int, b: int, k: int = 5) -> float | None:
    """Length of the shortest walk from a to b over each row's k nearest; None where none leads there."""
    n = len(vectors)
    if n < 3:
        return float(np.arccos(np.clip(vectors[a] @ vectors[b], -1, 1)))
    best, heap, done = {a: 0.0}, [(0.0, a)], set()
    while heap:
        far, u = heapq.heappop(heap)
        if u == b:
            return far
        if u in done:
            continue
        done.add(u)
        sims = vectors @ vectors[u]
        for v in np.argpartition(-sims, min(k, n - 1))[: min(k, n - 1) + 1].tolist():
            step = far + float(np.arccos(np.clip(sims[v], -1, 1)))
            if v != u and step < best.get(v, math.inf):
                best[v] = step
                heapq.heappush(heap, (step, v))
    return None


def by_group(rows: DataFrame, by: str, kernel, schema: str, order: str = "vec_id") -> DataFrame:
    """``kernel(key, ordered rows, matrix)`` for each group; a group must fit a task."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["v"].notna()].sort_values(order, kind="stable")
        names = [x.split()[0] for x in schema.split(", ")]
        if not len(part):
            return pd.DataFrame(columns=names)
        m = np.stack([_unit(np.asarray(v, float)) for v in part["v"]])
        return pd.DataFrame(kernel(key[0], part, m), columns=names)

    return rows.repartition(GROUPS, by).groupBy(by).applyInPandas(run, schema)
