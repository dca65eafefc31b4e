"""Where rows come from: version nodes and walks over the derivation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import columns as C
from marlstone.functions.checkpoint import durable


def nodes(writes: DataFrame) -> DataFrame:
    """One node a write: a creation derived from the latest nodes of its references then, or an update of the one before."""
    w = W.partitionBy("path").orderBy("seq")
    versioned = writes.select("seq", "path", "owner", "refs", C.value_hash(F.col("value")).alias("value_hash"), F.row_number().over(w).alias("version"), F.lag("seq").over(w).alias("before"), F.lead("seq").over(w).alias("_to"))
    spans = versioned.select(F.col("path").alias("ref"), F.col("seq").alias("parent"), F.col("_to"))
    born = versioned.where(F.col("version") == 1).select("seq", F.explode("refs").alias("ref"))
    parents = born.join(spans, "ref").where((F.col("parent") < F.col("seq")) & (F.col("_to").isNull() | (F.col("_to") >= F.col("seq")))).groupBy("seq").agg(F.array_sort(F.collect_set("parent")).alias("_ps"))
    out = versioned.join(parents, "seq", "left")
    return out.select("seq", "path", "owner", "value_hash", "version", F.when(F.col("version") > 1, "update").when(F.col("_ps").isNotNull(), "derived").otherwise("created").alias("derivation"), F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.coalesce("_ps", F.array().cast("array<bigint>"))).alias("parents"))


def recorded(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes with those of confirmations, contradictions and merges (seq, kind, path, owner, value_hash, sources).

    Each is derived from the latest node of its path (of each source, for a merge) before it: a confirmation keeps that
    node's hash and version, a contradiction has its own hash and the next version, a merge begins at version 1. Events of
    a path without a node are left out, but merges.
    """
    e = events.withColumn("_of", F.explode(F.when(F.col("kind") == "merge", F.col("sources")).otherwise(F.array("path"))))
    old = nodes.select(F.col("path").alias("_of"), F.col("seq").alias("_n"), F.col("value_hash").alias("_h"), F.col("version").alias("_v"))
    met = e.join(old, (e["_of"] == old["_of"]) & (F.col("_n") < F.col("seq")), "left").groupBy("seq", e["_of"]).agg(F.max_by(F.struct("_n", "_h", "_v"), "_n").alias("x"))
    parents = met.groupBy("seq").agg(F.array_sort(F.filter(F.collect_list("x._n"), lambda n: n.isNotNull())).alias("parents"), F.max("x._h").alias("_h"), F.max("x._v").alias("_v"))
    out = events.join(parents, "seq", "left").where((F.col("kind") == "merge") | (F.size("parents") > 0))
    kinds = {"confirm": "confirmed", "contradict": "contradicted", "merge": "merged"}
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    version = F.when(F.col("kind") == "confirm", F.col("_v")).when(F.col("kind") == "contradict", F.col("_v") + 1).otherwise(1)
    more = out.select("seq", "path", "owner", F.when(F.col("kind") == "confirm", F.col("_h")).otherwise(F.col("value_hash")).alias("value_hash"), version.cast("int").alias("version"), named.alias("derivation"), F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"))
    return nodes.select("seq", "path", "owner", "value_hash", F.col("version").cast("int").alias("version"), "derivation", "parents").union(more)


def shortest(edges: DataFrame, start: str, rounds: int = 100) -> DataFrame:
    """(node, cost): the cheapest way from a start over weighted edges (actor, target, cost), in rounds of relaxation that
    end when nothing gets cheaper; the frontier of each is written to the shared checkpoint folder."""
    spark = edges.sparkSession
    best = durable(spark.createDataFrame([(start, 0.0)], "node string, cost double"))
    frontier = best
    for _ in range(rounds):
        ahead = frontier.join(edges, frontier.node == edges.actor).select(F.col("target").alias("node"), (frontier["cost"] + edges["cost"]).alias("cost")).groupBy("node").agg(F.min("cost").alias("cost"))
        frontier = durable(ahead.join(best.select("node", F.col("cost").alias("_old")), "node", "left").where(F.col("_old").isNull() | (F.col("cost") < F.col("_old"))).select("node", "cost"))
        if frontier.isEmpty():
            return best
        best = durable(best.union(frontier).groupBy("node").agg(F.min("cost").alias("cost")))
    return best


def walk(edges: DataFrame, starts: DataFrame, depth: int = 20, up: bool = True) -> DataFrame:
    """(start, node, depth): all that is reached from each start, at its least depth; towards parents, or to children.

    Breadth first, one join a level; the frontier of each level is written to the shared checkpoint folder.
    """
    a, b = ("child", "parent") if up else ("parent", "child")
    e = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    frontier = durable(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    reached = frontier
    for d in range(1, depth + 1):
        ahead = frontier.join(e, frontier.node == e["_a"]).select("start", F.col("_b").alias("node")).distinct().join(reached.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        frontier = durable(ahead)
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def roots(edges: DataFrame, starts: DataFrame, depth: int = 100) -> DataFrame:
    """Those reached that have no parent."""
    return walk(edges, starts, depth).join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def lineage(edges: DataFrame, start: str, depth: int = 20) -> DataFrame:
    """One start's ancestors as a recursive query; it suits a point lookup, ``walk`` suits many starts."""
    spark = edges.sparkSession
    return spark.sql(
        "WITH RECURSIVE up (node, depth) AS (SELECT CAST(:s AS STRING), 0 UNION ALL SELECT e.parent, up.depth + 1 FROM up JOIN {e} e ON e.child = up.node WHERE up.depth < :d) SELECT node, min(depth) AS depth FROM up GROUP BY node",
        {"s": start, "d": depth},
        e=edges,
    )


def chain(edges: DataFrame, a: str, b: str, depth: int = 20) -> list[str] | None:
    """A shortest undirected path between two nodes; None where there is none."""
    both = edges.select("child", "parent").union(edges.select(F.col("parent"), F.col("child")))
    seen = walk(both.toDF("child", "parent"), edges.sparkSession.createDataFrame([(a,)], "start string"), depth)
    hit = seen.where(F.col("node") == b).first()
    if hit is None:
        return None
    out, at = [b], hit.depth
    while at:  # at most ``depth`` point lookups
        at -= 1
        back = both.toDF("x", "y").where(F.col("x") == out[-1]).select(F.col("y").alias("node")).join(seen.where(F.col("depth") == at), "node").agg(F.min("node")).first()[0]
        out.append(back)
    return out[::-1]
