"""Current state, history and maintenance as pure functions of the append-only write log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import columns as C

FIELDS = ("seq", "path", "value", "owner", "type", "confidence", "refs", "ttl", "updated_at")


def latest(writes: DataFrame) -> DataFrame:
    """The last write of each path, with its number of writes as version and the first write's time as created_at.

    An aggregate, not a window: each partition sends on one row a path, however many versions there are.
    """
    fields = [c for c in writes.columns if c != "path"]
    rows = writes.groupBy("path").agg(F.max_by(F.struct(*fields), "seq").alias("_last"), F.count(F.lit(1)).alias("version"), F.min_by("updated_at", "seq").alias("created_at"))
    return rows.select("path", *[F.col(f"_last.{c}").alias(c) for c in fields], "version", "created_at")


def versions(writes: DataFrame) -> DataFrame:
    """Every write with its version number, what the path held before it and until when it was current."""
    w = W.partitionBy("path").orderBy("seq")
    return writes.withColumns({
        "version": F.row_number().over(w), "created_at": F.first("updated_at").over(w),
        "previous_owner": F.lag("owner").over(w), "previous_value": F.lag("value").over(w), "previous_confidence": F.lag("confidence").over(w),
        "seq_end": F.lead("seq").over(w),
    })


def as_of(writes: DataFrame, when: float) -> DataFrame:
    """The state as it was at a time."""
    return latest(writes.where(F.col("updated_at") <= F.lit(when)))


def scan(rows: DataFrame, pattern: str = "**") -> DataFrame:
    return rows.where(C.glob(F.col("path"), pattern))


def without(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key is not among the tombstones."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def without_deleted(writes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Writes after the last deletion of their path; tombstones have path and seq. A path deleted last is gone."""
    last = tombstones.groupBy("path").agg(F.max("seq").alias("_gone"))
    return writes.join(last, "path", "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")


def purge(rows: DataFrame, *ttls: str) -> DataFrame:
    """Rows that stay once those of some lifetimes are cleared; turn and session go when a session ends."""
    return rows.where(F.col("ttl").isNull() | ~F.col("ttl").isin(*ttls))


def newest(rows: DataFrame, n: int, by: tuple[str, ...] = (), time: str = "updated_at", tie: str = "seq") -> DataFrame:
    """The n newest rows, of each group where ``by`` names one: a bounded history."""
    if not by:
        return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(time), F.desc(tie)))).where(F.col("_n") <= n).drop("_n")


def merged(updates: DataFrame) -> DataFrame:
    """In-place updates folded by path: fields that a write leaves null stay, metadata maps are merged, versions count."""
    keep = [c for c in updates.columns if c not in ("path", "seq", "metadata")]
    out = updates.groupBy("path").agg(
        F.max("seq").alias("seq"),
        F.count(F.lit(1)).alias("version"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in keep],
        F.array_sort(F.collect_list(F.struct("seq", F.map_entries("metadata").alias("m")))).alias("_m"),
    )
    merge = F.aggregate(F.flatten(F.transform("_m", lambda x: F.coalesce(x["m"], F.array()))), F.expr("cast(map() as map<string,string>)"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e))))
    return out.withColumn("metadata", merge).drop("_m")


def refused(rows: DataFrame) -> DataFrame:
    """Each row's reason to be refused; null where it is accepted."""
    return rows.withColumn("problem", F.coalesce(C.path_problem(F.col("path")), C.row_problem(F.col("value"), F.col("owner"), F.col("confidence"), F.col("type"), F.col("ttl"))))


def missing_vectors(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Paths to be embedded again and vectors without a row: what separates the live set from the stored one."""
    live, kept = rows.select("path").distinct(), vectors.where(F.size("v") == dim).select(F.col("path").alias("_p")).distinct()
    both = live.join(kept, live.path == kept["_p"], "full_outer")
    return both.where(F.col("path").isNull() | F.col("_p").isNull()).select(F.coalesce("path", "_p").alias("path"), F.when(F.col("_p").isNull(), "embed").otherwise("drop").alias("action"))


def latest_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """The last vector of each path and provider; those of another dimension are refused."""
    return vectors.where(F.size("v") == dim).groupBy("path", "provider").agg(F.max_by("v", "seq").alias("v"))


def readable(rows: DataFrame, patterns: list[str] | None, admin: bool = False) -> DataFrame:
    """Rows that an agent may read: all of them for an admin or where no policy is set."""
    if admin or patterns is None:
        return rows
    test: Column = F.lit(False)
    for p in patterns:
        test = test | C.glob(F.col("path"), p)
    return rows.where(test)


def may_read(patterns: list[str] | None, requested: str, admin: bool = False) -> bool:
    """Whether some pattern of the policy covers all that is requested."""
    return admin or patterns is None or any(C.covers(p, requested) for p in patterns)


def neighbours(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with those rows whose path has the same prefix and a number one lower or higher, ordered by path."""
    pattern = r"^(.*/)(\d{1,18})$"
    numbered = lambda d: d.withColumns({"_p": F.regexp_extract("path", pattern, 1), "_n": F.regexp_extract("path", pattern, 2)}).withColumn("_n", F.when(F.col("_n") != "", F.col("_n").cast("long")))
    near = numbered(hits.select("path")).where(F.col("_n").isNotNull()).select("_p", F.explode(F.array(F.col("_n") - 1, F.col("_n") + 1)).alias("_n")).distinct()
    found = numbered(rows).join(near, ["_p", "_n"], "left_semi").select("path")
    return rows.join(hits.select("path").union(found).distinct(), "path", "left_semi").orderBy("path")
