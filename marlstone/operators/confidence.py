"""Beta confidence of each path from its evidence, as sums over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import columns as C

CONFIRM, CONTRADICT, HALF_LIFE, Z = 1.0, 2.0, 7200.0, 1.645


def evidence(writes: DataFrame) -> DataFrame:
    """What each write is for its path: register at first, refresh by the same owner, else confirm or contradict."""
    w = W.partitionBy("path").orderBy("seq")
    other, before = F.lag("owner").over(w), F.lag("value").over(w)
    kind = F.when(F.row_number().over(w) == 1, "register").when(other == F.col("owner"), "refresh").when(C.normalised(F.col("value")) == C.normalised(before), "confirm").otherwise("contradict")
    return writes.select("seq", "path", kind.alias("kind"), F.col("owner").alias("agent"), "confidence", F.lit(1.0).alias("strength"), F.col("updated_at").alias("ts"))


def states(evidence: DataFrame) -> DataFrame:
    """alpha, beta, base confidence, counts and last update of each path since it was last registered.

    Evidence before the first register of a path counts for nothing; a refresh of an unknown path registers it. Sums
    over an aggregated cut, so order matters only through the last register.
    """
    opens = F.col("kind").isin("register")
    first = evidence.groupBy("path").agg(F.max(F.when(opens, F.col("seq"))).alias("_r"), F.min(F.when(F.col("kind") == "refresh", F.col("seq"))).alias("_f"))
    rows = evidence.join(first.select("path", F.coalesce("_r", "_f").alias("_start")), "path").where(F.col("seq") >= F.col("_start"))
    sets = F.when(F.col("kind").isin("register", "refresh"), F.col("seq"))
    at_start = F.col("seq") == F.col("_start")
    given = F.max(F.when(at_start, F.col("confidence")))
    return rows.groupBy("path").agg(
        (1 + given + CONFIRM * F.sum(F.when(F.col("kind") == "confirm", F.col("strength")).otherwise(0.0))).alias("alpha"),
        (2 - given + CONTRADICT * F.sum(F.when(F.col("kind") == "contradict", F.col("strength")).otherwise(0.0))).alias("beta"),
        F.max_by("confidence", sets).alias("base"),
        F.count_if(F.col("kind") == "confirm").alias("confirmations"),
        F.count_if(F.col("kind") == "contradict").alias("contradictions"),
        F.count_distinct("agent").alias("n_sources"),
        F.max_by("ts", "seq").alias("last_update"),
    )


def mean(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def variance(alpha: Column, beta: Column) -> Column:
    return alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))


def strength(alpha: Column, beta: Column) -> Column:
    return alpha + beta - 2


def lower_bound(alpha: Column, beta: Column) -> Column:
    """Wilson's lower bound of the mean; 0 without evidence."""
    n, p = alpha + beta, mean(alpha, beta)
    bound = (p + Z * Z / (2 * n) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    return F.greatest(F.lit(0.0), bound)


def effective(alpha: Column, beta: Column, base: Column) -> Column:
    """The base as long as there is little evidence, the mean once there is much."""
    w = F.least(F.lit(1.0), (alpha + beta - 2) / 10)
    return (1 - w) * base + w * mean(alpha, beta)


def decayed(raw: Column, age: Column, half_life: float = HALF_LIFE) -> Column:
    """Towards one half with age; unknown paths have one half."""
    return F.coalesce(0.5 + (raw - 0.5) * F.pow(F.lit(2.0), -age / half_life), F.lit(0.5))


def bulk_decay(states: DataFrame, now: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """alpha and beta shrunk towards the prior where the last update is older than a tenth of the half-life."""
    age = now - F.col("last_update")
    d = F.when(age > half_life / 10, F.pow(F.lit(2.0), -age / half_life)).otherwise(1.0)
    return states.withColumns({"alpha": 1 + (F.col("alpha") - 1) * d, "beta": 1 + (F.col("beta") - 1) * d, "touched": age > half_life / 10})


def agreement(evidence: DataFrame) -> DataFrame:
    """How often each agent confirmed another one that had written to the same path before, and how often not."""
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    met = evidence.withColumn("_s", F.collect_set("agent").over(before)).where(F.col("kind").isin("confirm", "contradict"))
    pairs = met.select(F.col("agent").alias("a"), F.explode("_s").alias("b"), "kind").where(F.col("a") != F.col("b"))
    out = pairs.groupBy("a", "b").agg(F.count_if(F.col("kind") == "confirm").alias("confirms"), F.count_if(F.col("kind") == "contradict").alias("contradicts"))
    return out.withColumn("agreement", F.col("confirms") / (F.col("confirms") + F.col("contradicts")))


def through_refs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Geometric mean of the confidences of what each row refers to (path, conf in ``known``; one half where unknown)."""
    refs = rows.select("path", F.explode("refs").alias("ref"))
    found = refs.join(known.select(F.col("path").alias("ref"), "conf"), "ref", "left")
    return found.groupBy("path").agg(F.exp(F.avg(F.log(F.greatest(F.coalesce("conf", F.lit(0.5)), F.lit(0.01))))).alias("propagated"))
