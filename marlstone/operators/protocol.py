"""Operators that exist as a written protocol only: other scores, decay, ratings, conflict resolution and near copies."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.checkpoint import durable
from marlstone.operators import similarity
from marlstone.operators.similarity import topk
from marlstone.operators.trust import folded

ELO_START, ELO_SCALE, ELO_K = 1500.0, 400.0, 32.0
TASKS, TASK_ROWS = 48, 20_000  # least tasks in which fingerprints meet, and rows (each listed ten times) of a task


def near_in_time(a: Column, b: Column, tau: float = 86400.0) -> Column:
    return F.exp(-F.abs(a - b) / tau)


def composite(relevance: Column, confidence: Column, trust: Column, recency: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * relevance + 0.25 * confidence + 0.20 * trust + 0.10 * recency))


def lazy_decay(confidence: Column, age: Column, half_life: float) -> Column:
    return F.greatest(F.lit(0.01), confidence * F.pow(F.lit(2.0), -age / half_life))


def prediction_penalty(days: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.1 * F.log2(1 + days))


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / ELO_SCALE))


def elo_trust(rating: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), 1 / (1 + F.pow(F.lit(10.0), (ELO_START - rating) / ELO_SCALE))))


def elo(matches: DataFrame) -> DataFrame:
    """Ratings after all matches (seq, winner, loser, and ``draw`` where the table has it) in order of seq.

    Each step depends on all before it, so one task walks the matches, packed and sorted in spans before, and holds
    these and a number an agent.
    """
    draws = F.coalesce(F.col("draw"), F.lit(False)) if "draw" in matches.columns else F.lit(False)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r: dict[str, float] = {}
        for p in parts:
            for w, x, even in zip(p["winner"], p["loser"], p["draw"], strict=True):
                a, b = r.get(w, ELO_START), r.get(x, ELO_START)
                step = ELO_K * ((0.5 if even else 1.0) - 1 / (1 + math.pow(10, (b - a) / ELO_SCALE)))
                r[w], r[x] = a + step, b - step
        yield pd.DataFrame({"agent": list(r), "rating": list(r.values())})

    return folded(matches.select("seq", "winner", "loser", draws.alias("draw")), fold, "agent string, rating double")


def regressed(rating: Column, idle_days: Column) -> Column:
    """A tenth of the way back to the start for a source idle for more than ninety days."""
    return F.when(idle_days > 90, rating + 0.1 * (ELO_START - rating)).otherwise(rating)


def merged_trust(rows: DataFrame, by: str, trust: str = "trust") -> DataFrame:
    """Trust of entries with several sources: that of the most trusted, within its bounds."""
    return rows.groupBy(by).agg(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.max(trust))).alias("trust"))


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights that add up to one."""
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


def boosted(score: Column, boost: Column | float = 0.0, penalty: Column | float = 0.0, fresh: Column | float = 0.0) -> Column:
    """A score after boosts (of tags and of freshness, up to double) and a penalty (of a source, down to half), clamped."""
    c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * (1 + c(boost)) * (1 + c(fresh)) * (1 - c(penalty))))


def explained(components: dict[str, Column], weights: dict[str, float]) -> Column:
    """The parts of a composite score: each component, its weight and their product, and the sum within [0, 1]."""
    w = normalised_weights(weights)
    parts = [F.struct(v.alias("value"), F.lit(w[k]).alias("weight"), (v * w[k]).alias("weighted")).alias(k) for k, v in components.items()]
    total = sum((v * w[k] for k, v in components.items()), F.lit(0.0))
    return F.struct(*parts, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("composite_score"))


def hybrid(scored: DataFrame, semantic: str, keyword: str, alpha: float = 0.7) -> DataFrame:
    """Semantic and keyword scores mixed; keyword scores are divided by the greatest, so they lie in [0, 1]."""
    best = scored.agg(F.max(keyword).alias("_best"))
    near = F.coalesce(F.when(F.col("_best") > 0, F.col(keyword) / F.col("_best")), F.lit(0.0))
    return scored.crossJoin(F.broadcast(best)).withColumn("hybrid", alpha * F.col(semantic) + (1 - alpha) * near).drop("_best")  # one row


def in_event_range(rows: DataFrame, start: float, end: float, time: str = "updated_at") -> DataFrame:
    return rows.where(F.col(time).between(start, end))


def by_proximity(rows: DataFrame, at: float, tau: float = 3600.0, time: str = "updated_at") -> DataFrame:
    """Rows by how near in time they are, with that as a score."""
    return rows.withColumn("proximity", near_in_time(F.col(time), F.lit(float(at)), tau)).orderBy(F.abs(F.col(time) - at), "path")


def search(rows: DataFrame, query: list[float], limit: int = 10, offset: int = 0, where: Column | None = None, oversampling: int = 3, now: float = 0.0) -> DataFrame:
    """Filter, the nearest rows in ``oversampling`` times the number wanted, the composite score, and a page of it.

    Filters go before the search at every selectivity: a scan takes them for nothing.
    """
    near = topk(rows if where is None else rows.where(where), query, oversampling * (limit + offset))
    score = composite(F.greatest(F.lit(0.0), "similarity"), F.col("confidence"), F.col("trust"), near_in_time(F.lit(float(now)), F.col("updated_at")))
    return near.withColumn("score", score).orderBy(F.desc("score"), "path").offset(offset).limit(limit)


def fingerprint64(text: Column) -> Column:
    """64-bit SimHash of a text's words."""

    @F.pandas_udf("bigint")
    def sign(texts: pd.Series) -> pd.Series:
        out, known = [], {}  # the hashes of this batch's words
        for t in texts:
            words = re.findall(r"\w+", t.lower()) if t else []
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) if len(h) else np.zeros(64)
            out.append(int(np.packbits(2 * bits > max(1, len(h))).view(np.int64)[0]))
        return pd.Series(out, dtype="int64")

    return sign(text)


def near_copies(rows: DataFrame, most: int = 3, least: float = 0.95, order: str = "seq") -> DataFrame:
    """(seq, copy_of, distance, similarity): each row (seq, path, source, content, v) whose fingerprint is within ``most``
    bits of an earlier one's and whose vector is as similar; the earliest such row.

    Rows meet by two of ``most`` + 2 blocks of bits, as two blocks at
    least are equal if at most ``most`` bits differ. Rows of equal blocks are multiplied as matrices in their task, and only
    the earliest copy of a row leaves it, so what is sent grows as the rows do, and not as the fingerprints that are near.
    """
    coded = durable(rows.select(order, "v", fingerprint64(F.col("content")).alias("_f")))
    tasks = max(TASKS, -(-coded.count() // TASK_ROWS))
    kind = dict(rows.dtypes)[order]
    cuts = [64 * i // (most + 2) for i in range(most + 3)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    keys = [m - (1 << 64) if (m := x | y) >> 63 else m for x, y in itertools.combinations(masks, 2)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows:
                yield pa.RecordBatch.from_arrays([*p.columns[:2], similarity.binary(similarity.units(p.column(2)))], names=["seq", "f", "x"])

    known = coded.where(F.col("v").isNotNull()).select(order, "_f", F.col("v").cast("array<double>").alias("v"))
    listed = known.mapInArrow(pack, f"seq {kind}, f bigint, x binary").select("*", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(k)) for k in keys])).alias("k", "part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for p in batches if p.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        seq, f, k, part = (t.column(c).to_numpy() for c in ("seq", "f", "k", "part"))
        m = similarity.unpacked(t.column("x"))
        at = np.lexsort((part, k))
        starts = np.flatnonzero(np.concatenate([[True], (part[at][1:] != part[at][:-1]) | (k[at][1:] != k[at][:-1])]))
        ends = np.append(starts[1:], len(at))
        best: dict = {}
        for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            own = at[lo:hi]
            own = own[np.argsort(seq[own], kind="stable")]
            for i, j in itertools.product(similarity.tiles(len(own), similarity.TILE[0]), similarity.tiles(len(own), similarity.TILE[1])):
                if j[0] >= i[1]:
                    continue  # none is earlier
                x, y = own[slice(*i)], own[slice(*j)]
                sims = m[x] @ m[y].T
                r, c = np.nonzero(sims >= least)
                d = np.bitwise_count(f[x[r]] ^ f[y[c]])
                ok = (d <= most) & (seq[y[c]] < seq[x[r]])
                for a, b, n, cos in zip(seq[x[r]][ok].tolist(), seq[y[c]][ok].tolist(), d[ok].tolist(), sims[r, c][ok].tolist()):
                    if a not in best or b < best[a][0]:
                        best[a] = (b, n, cos)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), t.schema.field("seq").type), pa.array([x[0] for x in best.values()], t.schema.field("seq").type), pa.array([x[1] for x in best.values()], pa.int32()), pa.array([x[2] for x in best.values()], pa.float64())], names=["seq", "_s", "d", "similarity"])

    found = listed.repartition(tasks, "k", "part").mapInArrow(meet, f"seq {kind}, _s {kind}, d int, similarity double")
    best = F.min_by(F.struct("_s", "d", "similarity"), F.col("_s"))
    return found.groupBy("seq").agg(best.alias("x")).select(F.col("seq").alias(order), F.col("x._s").alias("copy_of"), F.col("x.d").alias("distance"), F.col("x.similarity").alias("similarity"))


def ingest(rows: DataFrame, sources: list[str], embed, now: float = 0.0) -> DataFrame:
    """Rows (seq, path, content, tags, source, source_trust) through all stages of ingestion, each a column or two:

    ``problem`` (validation: content, size, source), content and tags normalised (trimmed, NFC, tags lower-cased, sorted,
    each once), ``copy_of`` an earlier row (of the same source: a problem; of another: derived from it, and that row's
    confidence is raised), quality and language hints, the vector that ``embed`` makes, confidence and score.
    """

    @F.pandas_udf("string")
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: unicodedata.normalize("NFC", t).strip(), na_action="ignore")

    text = F.col("content")
    bad = F.when(text.isNull() | (F.trim(text) == ""), "content").when(F.octet_length(text) > 262_144, "size").when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "source")
    rows = rows.withColumns({"problem": bad, "content": nfc(text), "tags": tags(F.coalesce("tags", F.array().cast("array<string>")))})
    words = F.size(F.split(F.trim("content"), r"\s+"))
    rows = rows.withColumn("quality", F.when(text.isNotNull(), F.least(F.lit(1.0), words / 50)))
    rows = durable(embed(rows, "content"))
    fit = rows.where(F.col("problem").isNull())
    copies = near_copies(fit).join(fit.select(F.col("seq").alias("copy_of"), F.col("source").alias("_src"), F.col("path").alias("_from")), "copy_of").select("seq", "copy_of", "_src", "_from")
    rows = rows.join(copies, "seq", "left")
    same = F.col("_src").isNotNull() & (F.col("_src") == F.col("source"))
    rows = rows.withColumns({"problem": F.coalesce("problem", F.when(same, "duplicate")), "derived_from": F.when(~same, F.col("_from")), "copy_of": F.when(~same, F.col("copy_of"))})
    raised = rows.where("problem IS NULL AND copy_of IS NOT NULL").groupBy(F.col("copy_of").alias("seq")).agg(F.count(F.lit(1)).alias("confirmed"))
    rows = rows.drop("_src", "_from", "copy_of").join(raised, "seq", "left")
    start = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("source_trust") + 0.3 * F.col("quality")))
    alpha = 1 + start + F.coalesce("confirmed", F.lit(0))
    rows = rows.withColumn("confidence", F.when(F.col("problem").isNull(), alpha / (alpha + 2 - start)))
    return rows.withColumn("score", F.when(F.col("problem").isNull(), composite(F.lit(0.5), F.col("confidence"), F.col("source_trust"), F.lit(1.0)))).drop("confirmed")


def resolve(pairs: DataFrame, margin: float = 0.1) -> DataFrame:
    """Which of two conflicting rows (a_ and b_ confidence, trust, at) wins and by what: confidence, trust, recency."""

    def by(x: str, least: float) -> Column:
        a, b = F.col(f"a_{x}"), F.col(f"b_{x}")
        return F.when(a - b > least, "a").when(b - a > least, "b")

    first, second, third = by("confidence", margin), by("trust", margin), by("at", 0.0)
    return pairs.withColumns({"winner": F.coalesce(first, second, third), "rule": F.when(first.isNotNull(), "confidence").when(second.isNotNull(), "trust").when(third.isNotNull(), "recency").otherwise("manual")})


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of the texts that hold some of the terms. Only matching words are counted, after each text's length."""
    words = docs.where(F.col("text").isNotNull()).select(key, F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "").alias("_w")).withColumn("_n", F.size("_w"))
    stats = words.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"))
    hits = words.select(key, "_n", F.explode(F.filter("_w", lambda w: w.isin(terms))).alias("term")).groupBy(key, "_n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    full = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a term; one row
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    return full.groupBy(key).agg(F.sum(s).alias("bm25"))


def content(text: Column) -> Column:
    return F.trim(text)


def tags(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(values, lambda x: F.lower(F.trim(x)))))


def token_windows(n_tokens: Column, size: int = 512, overlap: int = 64) -> Column:
    """Where chunks of so many tokens begin when they overlap."""
    last = F.greatest(F.lit(0), n_tokens - overlap - 1)
    return F.sequence(F.lit(0), F.floor(last / (size - overlap)).cast("int")) if size > overlap else F.array(F.lit(0))
