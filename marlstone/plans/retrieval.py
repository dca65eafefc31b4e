"""The ranked, budgeted read: scan, cap, score by four signals, choose (top k, diverse, reranked, neighbours), pack."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.checkpoint import durable
from marlstone.operators import kernels
from marlstone.operators.store import scan

CANDIDATES, MIN_VARIANCE, HALF_LIFE = 500, 0.001, 3600.0


@dataclass(frozen=True)
class Weights:
    """Weights of the signals; they add up to one."""

    recency: float = 0.30
    conf: float = 0.20
    sim: float = 0.30
    ref: float = 0.20

    def __post_init__(self):
        if abs(self.recency + self.conf + self.sim + self.ref - 1) > 0.01:
            raise ValueError("weights must add up to 1")

    def adapted(self, query: bool) -> Weights:
        """With a query similarity counts more and recency less; without one recency takes from similarity."""
        if query:
            return replace(self, recency=self.recency - 0.10, sim=self.sim + 0.10)
        return replace(self, recency=self.recency + 0.15, sim=self.sim - 0.15)


def recency(updated_at: Column, now: Column) -> Column:
    return F.pow(F.lit(2.0), -F.greatest(now - updated_at, F.lit(0.0)) / HALF_LIFE)


def reference(n: Column) -> Column:
    n = F.coalesce(n, F.lit(0))
    return F.when(n > 0, F.least(F.lit(1.0), 0.3 + 0.3 * F.log1p(n.cast("double")))).otherwise(0.1)


def in_degree(rows: DataFrame) -> DataFrame:
    """How many references point to each path."""
    return rows.select(F.explode("refs").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_refs"))


def candidates(rows: DataFrame, scope: str = "**", owner: str | None = None, kind: str | None = None, cap: int | None = CANDIDATES) -> DataFrame:
    found = scan(rows, scope)
    if owner is not None:
        found = found.where(F.col("owner") == owner)
    if kind is not None:
        found = found.where(F.col("type") == kind)
    return found if cap is None else found.orderBy(F.desc("updated_at"), "path").limit(cap)


def with_tokens(rows: DataFrame) -> DataFrame:
    p, v = F.col("path"), F.col("value")
    return rows.withColumns({"t_full": C.tokens_full(p, v, F.col("owner"), F.col("confidence")), "t_compact": C.tokens_compact(p, v), "t_path": C.tokens_path(p)})


def _order(*names: str):
    """A comparator of structs by some fields, as the others may be maps, which have no order."""

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for n in reversed(names):
            out = F.when(x[n] < y[n], -1).when(x[n] > y[n], 1).otherwise(out)
        return out

    return compare


def packed(rows: DataFrame, budget: int, stop: bool = True, path_only: bool = True) -> DataFrame:
    """Rows in order of ``rank`` as far as the budget goes: in full, else compact, else the path alone.

    The first that fits in no form ends it, or is only left out where ``stop`` is false. One fold over the ranked rows,
    which are at most some hundreds. Adds form, tokens and used.
    """
    key = F.array_sort(F.collect_list(F.struct("rank", "t_full", "t_compact", "t_path", *[c for c in rows.columns if c not in ("rank", "t_full", "t_compact", "t_path")])), _order("rank"))
    names = [*["rank", "t_full", "t_compact", "t_path"], *[c for c in rows.columns if c not in ("rank", "t_full", "t_compact", "t_path")]]
    kinds = dict(rows.dtypes)
    out = ", ".join(f"`{n}`: {kinds[n]}" for n in names)
    empty = F.expr(f"cast(array() as array<struct<{out}, form: string, tokens: bigint, used: bigint>>)")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), empty.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits = lambda t: acc["used"] + e[t] <= budget
        form = F.when(acc["over"], None).when(fits("t_full"), "full").when(fits("t_compact"), "compact")
        if path_only:
            form = form.when(fits("t_path"), "path")
        tokens = F.when(form == "full", e["t_full"]).when(form == "compact", e["t_compact"]).when(form == "path", e["t_path"])
        used = (acc["used"] + F.coalesce(tokens, F.lit(0))).cast("long")
        row = F.struct(*[e[n].alias(n) for n in names], form.alias("form"), tokens.cast("long").alias("tokens"), used.alias("used"))
        return F.struct(used.alias("used"), (acc["over"] | (F.lit(stop) & form.isNull())).alias("over"), F.when(form.isNotNull(), F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    return rows.groupBy().agg(F.aggregate(key, zero, step).alias("_f")).select(F.explode("_f.out").alias("_e")).select("_e.*")


PLAN = (
    "path string, rank int, score double, recency double, conf double, sim double, ref double, "
    "form string, tokens bigint, used bigint, total_matched bigint"
)


@dataclass(frozen=True)
class Read:
    """What a read wants, as the kernel over its candidates needs it."""

    budget: int
    query: tuple[float, ...] | None = None
    text: str | None = None
    weights: Weights = Weights()
    rerank: Callable[[str, list[str]], Sequence[float]] | None = None
    diversity: float = 0.7
    expand: bool = True

    def signals(self, c: pd.DataFrame) -> np.ndarray:
        """Recency, confidence, similarity and references of each candidate (rows x 4)."""
        age = np.maximum(c["now"].to_numpy(float) - c["updated_at"].to_numpy(float), 0.0)
        n = c["n_refs"].fillna(0).to_numpy(float)
        sim = np.full(len(c), 0.5)
        if self.query is not None and "v" in c:
            q = np.asarray(self.query, float)
            for i, v in enumerate(c["v"]):
                if v is not None:
                    sim[i] = max(0.0, float(np.dot(v, q)))
        ref = np.where(n > 0, np.minimum(1.0, 0.3 + 0.3 * np.log1p(n)), 0.1)
        return np.stack([2.0 ** (-age / HALF_LIFE), c["conf"].to_numpy(float), sim, ref], axis=1)

    def scores(self, signals: np.ndarray) -> np.ndarray:
        """Weighted sums. A signal that hardly varies tells nothing; its weight goes to the others in proportion."""
        w = self.weights.adapted(self.query is not None)
        base = np.array([w.recency, w.conf, w.sim, w.ref])
        live = np.where(signals.var(axis=0) > MIN_VARIANCE, base, 0.0)
        return np.round(signals @ (live * base.sum() / live.sum() if live.sum() > 0 else base), 9)

    def chosen(self, c: pd.DataFrame, score: np.ndarray) -> list[int]:
        """Rows to pack, in order: the best k; diverse ones where several owners answer a query; the reranker's where
        there is one; and, where a single owner answers, with the numbered neighbours of each, in order of path."""
        k = min(len(c), max(10, 2 * (self.budget // max(1, int(c["t_full"].sum()) // len(c)))))
        owners = c["owner"].nunique()
        by_score = sorted(range(len(c)), key=lambda i: (-score[i], c["path"].iat[i]))
        best = by_score[:k]
        if self.query is not None and owners > 1 and len(c) > k:
            v = c["v"].tolist() if "v" in c else [None] * len(c)
            best = kernels.mmr(list(score), v, k, self.diversity) if any(x is not None for x in v) else best
        if self.rerank is not None and self.text:
            told = self.rerank(self.text, [x[:1500] for x in c["value"]])
            best = sorted(range(len(c)), key=lambda i: (-float(told[i]), i))[:k]
        if self.expand and self.query is not None and owners <= 1:
            at = {p: i for i, p in enumerate(c["path"])}
            found = set(best)
            for i in best:
                if m := re.fullmatch(r"(.*/)(\d+)", c["path"].iat[i]):
                    found |= {at[p] for n in (int(m[2]) - 1, int(m[2]) + 1) if (p := f"{m[1]}{n}") in at}
            best = sorted(found, key=lambda i: c["path"].iat[i])
        return best

    def plan(self, c: pd.DataFrame) -> pd.DataFrame:
        """Forms and tokens of what is packed: in full, else compact, else the path; the first that fits in no form ends it."""
        signals = self.signals(c)
        score = self.scores(signals)
        used, out = 0, []
        for rank, i in enumerate(self.chosen(c, score)):
            for form in ("full", "compact", "path"):
                t = int(c[f"t_{form}"].iat[i])
                if used + t <= self.budget:
                    used += t
                    out.append((c["path"].iat[i], rank, score[i], *signals[i], form, t, used, len(c)))
                    break
            else:
                break
        return pd.DataFrame(out, columns=[x.split()[0] for x in PLAN.split(", ")])


def get(
    rows: DataFrame, scope: str = "**", budget: int = 2000, query: list[float] | None = None, owner: str | None = None, kind: str | None = None,
    now: float | None = None, cap: int = CANDIDATES, signal: Column | None = None, text: str | None = None,
    rerank: Callable[[str, list[str]], Sequence[float]] | None = None, weights: Weights = Weights(), diversity: float = 0.7,
) -> DataFrame:
    """The flagship read over current rows (columns of the log; v where they have vectors): rows to show within a token
    budget, with rank, signals, score, form, tokens and the number of candidates.

    The rows are written once (they are an aggregate of the log); from that, one pass finds the ``cap`` newest of the
    scope and one counts the references to them. What is ranked and packed is these candidates, ``cap`` at most, in one
    task, whatever the size of the log. ``signal`` replaces the stored confidence. ``now`` is the newest write where it
    is not given. A row without a vector, or a read without a query, has similarity 0.5.
    """
    rows = durable(rows)
    found = candidates(rows, scope, owner, kind, cap)
    vector = ["v"] if query is not None and "v" in rows.columns else []
    told = (F.col("confidence") if signal is None else signal).alias("conf")
    slim = durable(with_tokens(found).select("path", "value", "owner", "updated_at", told, *vector, "t_full", "t_compact", "t_path"))
    refs = rows.select(F.explode("refs").alias("path")).join(F.broadcast(slim.select("path")), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n_refs"))  # at most ``cap`` rows
    at = rows.agg(F.max("updated_at").alias("now")) if now is None else None
    full = slim.join(F.broadcast(refs), "path", "left")  # a row a candidate
    full = full.crossJoin(F.broadcast(at)) if at is not None else full.withColumn("now", F.lit(float(now)))  # one row
    wanted = Read(budget, None if query is None else tuple(float(x) for x in query), text, weights, rerank, diversity)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(parts), ignore_index=True)
        if len(own):
            yield wanted.plan(own.sort_values(["updated_at", "path"], ascending=[False, True], kind="stable", ignore_index=True))

    plan = full.repartition(1).mapInPandas(work, PLAN)
    rest = [c for c in rows.columns if c not in ("recency", "conf", "sim", "ref", "score", "rank", "form", "tokens", "used", "total_matched")]
    return rows.select(*rest).join(F.broadcast(plan), "path").select("rank", *rest, "recency", "conf", "sim", "ref", "score", "form", "tokens", "used", "total_matched")
