"""Vector columns: arrays of doubles, all kernels as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain column in a lambda would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(a: Column) -> Column:
    """Unit length; a vector of almost no length stays as it is."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > TINY, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > TINY, dot(a, b) / n).otherwise(0.0)


def clip(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def angle(cos: Column) -> Column:
    return F.acos(clip(cos))


def relation(cos: Column) -> dict[str, Column]:
    """What two vectors are to each other, from their cosine; each is rounded to six places."""
    c, zero = clip(cos), F.lit(0.0)
    parts = {"cosine": c, "angular_dist": F.acos(c), "projection": F.abs(c), "residual": F.sqrt(F.greatest(zero, 1 - c * c)), "parallelism": F.greatest(zero, c), "opposition": F.greatest(zero, -c), "independence": 1 - F.abs(c)}
    return {k: F.round(v, 6) for k, v in parts.items()}


def kinship(cos: Column) -> dict[str, Column]:
    """Five scores of how two unit vectors belong together, rounded to four places."""
    c, zero = clip(cos), F.lit(0.0)
    gap = F.sqrt(F.greatest(zero, 2 - 2 * c))
    parts = {"similarity": F.greatest(zero, c), "complementary": F.least(F.lit(1.0), gap / 2**0.5) * (1 - F.abs(c)), "hierarchical": zero, "contradictory": F.greatest(zero, -c), "independent": F.greatest(zero, 1 - F.abs(c) * 3)}
    return {k: F.round(v, 4) for k, v in parts.items()}


def interpolate(a: Column, b: Column, t: float = 0.5, mode: str = "slerp") -> Column:
    """Between two unit vectors along the sphere; along the line for mode lerp or where they are (anti)parallel."""
    flat = F.struct(F.lit(1.0 - t).alias("a"), F.lit(float(t)).alias("b"))
    if mode == "lerp":
        factors = flat
    else:
        turn = lambda w: F.struct((F.sin((1 - t) * w) / F.sin(w)).alias("a"), (F.sin(t * w) / F.sin(w)).alias("b"))
        factors = let(clip(dot(a, b)), lambda d: F.when(F.abs(d) > 0.9999, flat).otherwise(let(F.acos(d), turn)))
    return normalise(let(factors, lambda f: F.zip_with(a, b, lambda x, y: x * f["a"] + y * f["b"])))


def analogy(a: Column, b: Column, c: Column) -> Column:
    return normalise(F.zip_with(c, F.zip_with(b, a, lambda x, y: x - y), lambda x, y: x + y))


def truncate(a: Column, d: int) -> Column:
    """The first ``d`` dimensions at unit length."""
    return normalise(F.slice(a, 1, d))
