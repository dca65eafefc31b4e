"""Trust between agents: an ordered fold over their confirmations and contradictions, decay, rankings, PageRank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.checkpoint import durable

K, START, DECAY, RELIABLE = 32.0, 0.5, 86400.0, 5
DAMPING, ROUNDS, EPSILON = 0.85, 20, 1e-6
SPAN = 65_536  # numbers of a span of the log that is packed as one
FOLDED = "agent string, trust double, confirmations bigint, contradictions bigint, interactions bigint, last_active double, domains map<string,double>, domain_events map<string,bigint>"


def folded(rows: DataFrame, fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``fold`` over all rows in order of ``seq``, in one task.

    Spans of ``SPAN`` numbers are sorted and packed where they are, with each name written once a span, and only these
    spans are sorted by the one task, which unpacks them one by one. So it holds a few bytes a row, not rows.
    """
    names = [c for c in rows.columns if c != "seq"]

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("seq").select(names).combine_chunks()
        t = pa.table({c: t.column(c).dictionary_encode() if pa.types.is_string(t.column(c).type) else t.column(c) for c in names})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return pa.table({"span": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def plain(x: pa.Array) -> np.ndarray | pd.Series:
        if x.null_count:
            return pd.Series(x.to_pylist(), dtype=object)
        return np.array(x.dictionary.to_pylist(), object)[x.indices.to_numpy()] if pa.types.is_dictionary(x.type) else x.to_numpy(zero_copy_only=False)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpacked() -> Iterator[pd.DataFrame]:
            for p in parts:
                for x in p["rows"]:
                    t = pa.ipc.open_stream(x).read_all()
                    yield pd.DataFrame({c: plain(t.column(c).combine_chunks()) for c in names})

        return fold(unpacked())

    spans = rows.groupBy(F.floor(F.col("seq") / SPAN).cast("long").alias("span")).applyInArrow(pack, "span bigint, rows binary")
    return spans.repartition(1).sortWithinPartitions("span").mapInPandas(work, schema)


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state: dict[str, dict] = {}

    def of(agent: str) -> dict:
        return state.setdefault(agent, {"trust": START, "yes": 0, "no": 0, "n": 0, "at": 0.0, "domain": {}, "count": {}})

    for part in parts:
        for kind, actor, target, domain, ca, ct, ts in zip(part.kind, part.actor, part.target, part.domain, part.conf_actor, part.conf_target, part.ts, strict=True):
            a, t = of(actor), of(target)
            if kind == "confirmation":
                step = K * (1 - 1 / (1 + math.exp(-4 * (t["trust"] - 0.5)))) / 100
                t["trust"] = min(1.0, t["trust"] + step)
                a["trust"] = min(1.0, a["trust"] + step / 2)
                t["domain"][domain] = min(1.0, t["domain"].get(domain, START) + step)
                t["yes"] += 1
            else:
                step = K / 100
                up, down = (a, t) if ca > ct else (t, a)
                if ca == ct:
                    a["trust"], t["trust"] = max(0.0, a["trust"] - step * 0.2), max(0.0, t["trust"] - step * 0.2)
                else:
                    up["trust"], down["trust"] = min(1.0, up["trust"] + step * 0.3), max(0.0, down["trust"] - step)
                t["domain"][domain] = max(0.0, t["domain"].get(domain, START) - step)
                t["no"] += 1
            t["count"][domain] = t["count"].get(domain, 0) + 1
            for x in (a, t):
                x["n"] += 1
                x["at"] = max(x["at"], ts)
    yield pd.DataFrame([(k, s["trust"], s["yes"], s["no"], s["n"], s["at"], s["domain"], s["count"]) for k, s in state.items()], columns=["agent", "trust", "confirmations", "contradictions", "interactions", "last_active", "domains", "domain_events"])


def fold(events: DataFrame) -> DataFrame:
    """Profiles after all events in order of ``seq``.

    Each step depends on all before it and across agents, so one task walks the events, packed and sorted in spans
    before; it holds these and a profile an agent. ``actor``, ``target`` and ``domain`` must not be null.
    """
    cols = ["seq", "kind", "actor", "target", "domain", "conf_actor", "conf_target", "ts"]
    return folded(events.select(*cols), _fold, FOLDED)


def edges(events: DataFrame) -> DataFrame:
    """Weight of who trusts whom: from one half up by 0.05 a confirmation, down by 0.1 a contradiction, within 0 and 1."""
    step = F.when(F.col("kind") == "confirmation", 0.05).otherwise(-0.1)
    walk = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", step.alias("d")))), F.lit(0.5), lambda w, e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w + e["d"])))
    return events.groupBy("actor", "target").agg(walk.alias("weight"))


def for_domain(trust: Column, domain_trust: Column, n_events: Column) -> Column:
    """Domain trust counts more the more events it rests on; without any it is the global trust."""
    w = F.least(F.lit(1.0), n_events / 10)
    return F.coalesce((1 - w) * trust + w * domain_trust, trust)


def decayed(trust: Column, idle: Column) -> Column:
    return 0.5 + (trust - 0.5) * F.exp(-idle / DECAY)


def profiles(events: DataFrame, now: Column) -> DataFrame:
    """Rates and activity of each agent."""
    parts = events.select(F.col("target").alias("agent"), "kind", F.lit(True).alias("told"), "ts").union(events.select("actor", "kind", F.lit(False), "ts"))
    out = parts.groupBy("agent").agg(F.count_if(F.col("told") & (F.col("kind") == "confirmation")).alias("confirmations"), F.count_if(F.col("told") & (F.col("kind") == "contradiction")).alias("contradictions"), F.count(F.lit(1)).alias("interactions"), F.max("ts").alias("last_active"))
    told = F.col("confirmations") + F.col("contradictions")
    return out.withColumns({"confirmation_rate": F.when(told > 0, F.col("confirmations") / told).otherwise(0.5), "reliable": F.col("interactions") >= RELIABLE, "activity": F.exp(-(now - F.col("last_active")) / 3600)})


def pagerank(edges: DataFrame, agents: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON, by: str = "target") -> DataFrame:
    """Power iteration over weighted edges (actor, target, weight).

    Each weight is divided by the sum of its target's (as in-trust is shared), or of its actor's where ``by`` is actor.
    Scores are divided by the greatest. Each round is written to the shared checkpoint folder, so its plan stays short.
    """
    e = edges.where(F.col("weight") != 0)
    total = e.groupBy(by).agg(F.sum("weight").alias("_t"))
    m = durable(e.join(total, by).select("actor", "target", (F.col("weight") / F.col("_t")).alias("w")))
    if agents is None:
        agents = edges.select(F.col("actor").alias("agent")).union(edges.select("target")).distinct()
    agents = durable(agents)
    n = agents.count()
    if n == 0:
        return agents.withColumn("score", F.lit(0.0))
    scores = agents.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        got = m.join(scores.withColumnRenamed("agent", "actor"), "actor").groupBy("target").agg(F.sum(F.col("w") * F.col("score")).alias("_g"))
        step = scores.join(got.withColumnRenamed("target", "agent"), "agent", "left").select("agent", F.col("score").alias("_old"), ((1 - damping) / n + damping * F.coalesce("_g", F.lit(0.0))).alias("score"))
        step = durable(step)
        moved = step.agg(F.sqrt(F.sum((F.col("score") - F.col("_old")) ** 2))).first()[0]
        scores = step.drop("_old")
        if epsilon and moved < epsilon:
            break
    best = scores.agg(F.max("score").alias("_m"))
    return scores.crossJoin(F.broadcast(best)).select("agent", (F.col("score") / F.col("_m")).alias("score"))  # one row
