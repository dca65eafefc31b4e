"""What a reader has not seen yet, without repeats, by how much each row tells for its tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import columns as C
from marlstone.functions import vectors as V
from marlstone.functions.checkpoint import durable
from marlstone.operators import similarity

SAME = 0.92


def delta(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """new, updated or unchanged for a reader: by path and version, or by the hash of a value seen at any path.

    ``seen`` has path, version and value_hash of one reader.
    """
    known = seen.groupBy("path").agg(F.max("version").alias("_v"))
    hashes = seen.select(F.col("value_hash").alias("_h")).distinct()
    full = rows.withColumn("value_hash", C.value_hash(F.col("value"))).join(known, "path", "left").join(hashes, F.col("value_hash") == F.col("_h"), "left")
    state = F.when(F.col("_v").isNull() & F.col("_h").isNull(), "new").when(F.col("_v").isNull(), "unchanged").when(F.col("version") > F.col("_v"), "updated").otherwise("unchanged")
    return full.withColumn("delta", state).drop("_v", "_h")


def mark_seen(seen: DataFrame, rows: DataFrame, reader: str) -> DataFrame:
    """The reader's table once these rows were read: the last version of each path."""
    new = rows.select(F.lit(reader).alias("reader"), "path", "version", C.value_hash(F.col("value")).alias("value_hash"))
    return seen.select("reader", "path", "version", "value_hash").union(new).groupBy("reader", "path").agg(F.max("version").alias("version"), F.max_by("value_hash", "version").alias("value_hash"))


def without_same_text(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each text."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(C.value_hash(F.col("value"))).orderBy(order))).where(F.col("_n") == 1).drop("_n")


def without_same_vectors(rows: DataFrame, order: str = "vec_id", threshold: float = SAME) -> DataFrame:
    """Rows, in ``order`` (unique numbers), whose vector is near none that was kept; rows without a vector stay.

    Only pairs over the threshold matter: a row goes if an earlier near row is kept, and is kept if all earlier near rows
    go. Rounds decide all rows whose earlier near rows are decided, until none is open; each is written to the shared
    checkpoint folder. A round costs as much as there are pairs, not as rows squared.
    """
    near = durable(similarity.pairs_over(rows.where(F.col("v").isNotNull()), threshold, order).where(F.col("similarity") > threshold).select("a", "b"))
    open_ = durable(near.select(F.col("b").alias("k")).distinct())
    gone = open_.limit(0)
    kept_now = durable(near.select(F.col("a").alias("k")).distinct().join(open_, "k", "left_anti"))
    while True:
        lost = durable(near.join(kept_now, near.a == kept_now.k, "left_semi").select(F.col("b").alias("k")).distinct().join(open_, "k", "left_semi"))
        gone = durable(gone.union(lost))
        open_ = durable(open_.join(lost, "k", "left_anti"))
        if open_.isEmpty():
            break
        blocked = near.join(gone, near.a == gone.k, "left_anti").join(open_, F.col("b") == open_.k, "left_semi").select(F.col("b").alias("k")).distinct()
        kept_now = durable(open_.join(blocked, "k", "left_anti"))
        open_ = durable(open_.join(kept_now, "k", "left_anti"))
        if kept_now.isEmpty():
            raise RuntimeError("no row could be decided")
    return rows.join(gone.withColumnRenamed("k", order), order, "left_anti")


def by_class(rows: DataFrame, order: str = "position") -> DataFrame:
    """Rows with their delta as they are read: new ones, then updated ones, then unchanged ones, each in ``order``."""
    rank = F.when(F.col("delta") == "new", 0).when(F.col("delta") == "updated", 1).otherwise(2)
    return rows.withColumn("class", rank).orderBy("class", order)


def compress(rows: DataFrame, seen: DataFrame | None = None, budget: int = 2000, order: str = "position", threshold: float = SAME) -> DataFrame:
    """What a reader should get of the rows of a read, in order: without repeats, densest first where there are vectors
    (column v), in full or compact as far as the budget goes. A row that fits in neither form is passed over.

    Adds rank, form, tokens, used, and the counts of the whole: n_original, n_unchanged, n_removed, n_tokens (of the rows
    that are no repeats). With ``seen`` (path, version and value_hash of one reader) new rows go first, then updated, then
    unchanged ones. Equal texts are one aggregate; the rest is a fold over the sorted rows, each step of which depends on
    the one before, so one task streams them; it holds the vectors that it kept.
    """
    rows = delta(rows, seen) if seen is not None else rows.withColumn("delta", F.lit("new")).withColumn("value_hash", C.value_hash(F.col("value")))
    rows = rows.withColumn("class", F.when(F.col("delta") == "new", 0).when(F.col("delta") == "updated", 1).otherwise(2))
    counts = rows.agg(F.count(F.lit(1)).alias("n_original"), F.count_if(F.col("delta") == "unchanged").alias("n_unchanged"))
    has_v = "v" in rows.columns
    rows = rows.withColumns({"_full": C.tokens_full(F.col("path"), F.col("value"), F.col("owner"), F.col("confidence")), "_compact": C.tokens_compact(F.col("path"), F.col("value"))})
    slim = rows.select("path", "class", order, "value_hash", "confidence", "_full", "_compact", *(["v"] if has_v else []))
    if not has_v:
        slim = slim.groupBy("value_hash").agg(F.min_by(F.struct(*slim.columns), F.struct("class", order)).alias("x")).select("x.*")
    schema = "path string, rank int, form string, tokens bigint, used bigint, n_kept bigint, n_tokens bigint"

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []
        known: list[np.ndarray] = []
        for part in parts:
            for k, path in enumerate(part["path"]):
                v = part["v"].iat[k] if has_v else None
                if v is not None:
                    u = np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-12)
                    if known and float(np.max(np.stack(known) @ u)) > threshold:
                        continue
                    known.append(u)
                dense = (0.8 + 0.2 * part["confidence"].iat[k]) / part["_full"].iat[k] * 100 if has_v else 0.0
                kept.append((path, int(part["_full"].iat[k]), int(part["_compact"].iat[k]), dense))
        kept.sort(key=lambda x: -x[3])  # stable: rows of one density stay in order
        used, out = 0, []
        for rank, (path, full, compact, _) in enumerate(kept):
            form, tokens = ("full", full) if used + full <= budget else ("compact", compact)
            if used + tokens <= budget:
                used += tokens
                out.append((path, rank, form, tokens, used, len(kept), sum(x[1] for x in kept)))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    plan = slim.repartition(1).sortWithinPartitions("class", order).mapInPandas(fold, schema)
    out = rows.drop("_full", "_compact", "class").join(F.broadcast(plan), "path").crossJoin(F.broadcast(counts))  # at most ``budget`` rows; one row
    return out.withColumn("n_removed", F.col("n_original") - F.col("n_kept")).drop("n_kept")


def compression_stats(packed: DataFrame) -> DataFrame:
    """Counts, savings and ratio of a compressed read, in one row."""
    one = packed.agg(F.max("n_original").alias("original"), F.count(F.lit(1)).alias("compressed"), F.max("n_removed").alias("duplicates"), F.max("n_unchanged").alias("unchanged"), F.max("n_tokens").alias("_all"), F.max("used").alias("_used"))
    return one.select("original", "compressed", "duplicates", "unchanged", (F.col("_all") - F.col("_used")).alias("saved"), F.round(F.col("_used") / F.greatest(F.lit(1), "_all"), 4).alias("ratio"))


def _nearest_of(spark, known: np.ndarray):
    """The cosine of a vector and the nearest of some unit vectors; no number where there is no vector."""
    sent = spark.sparkContext.broadcast(known)

    @F.pandas_udf("double")
    def near(v: pd.Series) -> pd.Series:
        ok, out = v.notna().to_numpy(), np.full(len(v), np.nan)
        if ok.any():
            m, best = similarity._matrix(v[ok]), np.full(int(ok.sum()), -np.inf)
            for i, j in similarity.tiles(len(m), similarity.TILE[0]):
                for at, to in similarity.tiles(len(sent.value), similarity.TILE[1]):
                    best[i:j] = np.maximum(best[i:j], (m[i:j] @ sent.value[at:to].T).max(axis=1))
            out[ok] = best
        return pd.Series(out)

    return near


def density(rows: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Information per token: half for text not in the context, 0.3 for semantic novelty, 0.2 for confidence, times 100.

    Semantic novelty is one less the likeness of the nearest vector of the context; without vectors on both sides it is 1.
    The context is what a reader already has and fits one task: its vectors (not its rows) go through the driver to all
    tasks as one matrix, and batches of rows are multiplied with it tile by tile.
    """
    novel = F.lit(1.0)
    apart = F.lit(1.0)
    if context is not None and "v" in rows.columns and "v" in context.columns:
        known = similarity.packed(context.select("v", F.lit(0).alias("_k")), "_k").select("x").toArrow()["x"]
        if len(known):
            rows = rows.withColumn("_near", F.when(F.col("v").isNotNull(), _nearest_of(rows.sparkSession, similarity.unpacked(known))("v")))
            apart = F.when(F.col("_near").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("_near")))
    if context is not None:
        rows = rows.withColumn("_h", C.value_hash(F.col("value"))).join(context.select(C.value_hash(F.col("value")).alias("_c")).distinct(), F.col("_h") == F.col("_c"), "left")
        novel = F.when(F.col("_c").isNull(), 1.0).otherwise(0.0)
    tokens = C.tokens_full(F.col("path"), F.col("value"), F.col("owner"), F.col("confidence"))
    return rows.withColumn("density", (0.5 * novel + 0.3 * apart + 0.2 * F.col("confidence")) / tokens * 100).drop("_h", "_c", "_near")


def near_pairs(rows: DataFrame, planes: np.ndarray, least: float) -> DataFrame:
    """All pairs of rows (path, v) whose sign fingerprints are similar enough; sides of rows meet each other."""

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                out = (np.stack([np.asarray(v, float) for v in p["v"]]) @ planes.T > 0).astype(np.uint8)
                yield pd.DataFrame({"path": p["path"], "x": [x.tobytes() for x in np.packbits(out, axis=1)]})

    coded = rows.select("path", "v").where(F.col("v").isNotNull()).mapInPandas(sign, "path string, x binary")
    return similarity.code_pairs(coded, least, len(planes), "path", "string")
