"""The log as a stream: change and deletion events, subscriptions, reasoning a batch at a time, limits with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.functions import columns as C
from marlstone.operators import reasoning
from marlstone.operators.store import newest

EVENT = "type string, path string, data map<string,string>, source_owner string, ts double"


def log_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of the write log as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def change_events(writes: DataFrame) -> DataFrame:
    """One change event a write; the same for a stream and a table."""
    data = F.create_map(F.lit("owner"), F.col("owner"), F.lit("type"), F.col("type"), F.lit("channel"), F.lit("text"))
    return writes.select(F.lit("change").alias("type"), "path", data.alias("data"), F.col("owner").alias("source_owner"), F.col("updated_at").alias("ts"))


def delete_events(tombstones: DataFrame) -> DataFrame:
    """One deletion event a tombstone (path, ts)."""
    return tombstones.select(F.lit("delete").alias("type"), "path", F.expr("cast(map() as map<string,string>)").alias("data"), F.lit(None).cast("string").alias("source_owner"), "ts")


def matching(events: DataFrame, subscriptions: dict[str, str]) -> DataFrame:
    """Each event once for each subscriber (name: pattern) whose pattern it matches."""
    hits = F.filter(F.array(*[F.when(C.glob(F.col("path"), p), F.lit(s)) for s, p in sorted(subscriptions.items())]), lambda x: x.isNotNull())
    return events.withColumn("subscriber", F.explode(hits))


def subscribe(events: DataFrame, pattern: str, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A running subscription; ``stop()`` on what it returns ends it. Delivery is at least once a batch."""
    return events.where(C.glob(F.col("path"), pattern)).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def reason_by_batch(writes: DataFrame, history: Callable[[], DataFrame], deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Contradiction events of each batch of writes against the table of all writes, which holds the batch too; only the
    batch's writes are joined with what was current."""

    def work(batch: DataFrame, n: int) -> None:
        deliver(reasoning.contradictions(history(), new=batch), n)

    return writes.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()


def of_types(events: DataFrame, *types: str) -> DataFrame:
    """Events of some types, for subscriptions by type."""
    return events.where(F.col("type").isin(*types))


def history(events: DataFrame, most: int = 1000) -> DataFrame:
    """The newest ``most`` events, as a bounded history keeps them, and how many were dropped."""
    total = events.agg((F.greatest(F.count(F.lit(1)) - most, F.lit(0))).alias("dropped"))
    return newest(events, most, time="ts", tie="path").crossJoin(F.broadcast(total))  # one row


def counts_by_window(writes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: writes a prefix and hour, with late rows taken up to the watermark."""
    timed = writes.withColumn("at", F.timestamp_micros((F.col("updated_at") * 1_000_000).cast("long"))).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), C.prefix(F.col("path")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "prefix", "n")


def _allow(times: list[float], tokens: float, last: float, rate: float, burst: float) -> tuple[list[bool], float, float]:
    out = []
    for t in times:
        tokens, last = min(burst, tokens + max(0.0, t - last) * rate), max(t, last)
        ok = tokens >= 1.0
        tokens -= ok
        out.append(ok)
    return out, tokens, last


def rate_limited(requests: DataFrame, rate: float = 100.0, burst: float = 100.0) -> DataFrame:
    """Whether a token bucket of each key lets a request (key, ts) pass; on a stream the bucket is state."""
    schema = "key string, ts double, allowed boolean"

    if not requests.isStreaming:

        def batch(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("ts", kind="stable")
            t = part["ts"].tolist()
            return pd.DataFrame({"key": part["key"], "ts": t, "allowed": _allow(t, burst, t[0] if t else 0.0, rate, burst)[0]})

        return requests.select("key", "ts").groupBy("key").applyInPandas(batch, schema)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = sorted(x for p in parts for x in p["ts"])
        tokens, last = state.get if state.exists else (burst, t[0] if t else 0.0)
        ok, tokens, last = _allow(t, tokens, last, rate, burst)
        state.update((tokens, last))
        yield pd.DataFrame({"key": [key[0]] * len(t), "ts": t, "allowed": ok})

    return requests.select("key", "ts").groupBy("key").applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def breaker_states(calls: DataFrame, failures: int = 5, rest: float = 60.0) -> DataFrame:
    """State of each provider's circuit breaker before each call (provider, ts, ok): closed, open or half_open."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable")
        n, opened, out = 0, None, []
        for t, ok in zip(part["ts"], part["ok"], strict=True):
            state = "closed" if opened is None else "half_open" if t - opened >= rest else "open"
            out.append(state)
            if state == "open":
                continue  # refused: it is neither success nor failure
            if ok:
                n, opened = 0, None
            else:
                n += 1
                if n >= failures or state == "half_open":
                    opened = t
        return pd.DataFrame({"provider": part["provider"], "ts": part["ts"], "state": out})

    return calls.select("provider", "ts", "ok").groupBy("provider").applyInPandas(fold, "provider string, ts double, state string")
