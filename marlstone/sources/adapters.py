"""The model's tables made of the tables at hand, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.vectors import normalise

WRITES = """writes AS (SELECT event_id AS seq, 'task/' || event_type || '/u' || user_id AS path,
  event_type || ' value=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, 'agent-' || (event_id % 7) AS owner,
  CASE event_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'decision' WHEN 2 THEN 'plan' ELSE 'observation' END AS type,
  CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
  CASE event_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['task/error/u' || (user_id + 1)]
    ELSE ['task/view/u' || (user_id % 20), 'task/click/u' || (user_id % 20)] END AS refs,
  CASE event_id % 3 WHEN 0 THEN 'turn' WHEN 1 THEN 'session' ELSE 'persistent' END AS ttl,
  epoch_us(ts) / 1e6 AS updated_at FROM events)"""
CURRENT = (
    WRITES
    + """, cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, count(*) OVER (PARTITION BY path) AS version,
  first_value(updated_at) OVER (PARTITION BY path ORDER BY seq) AS created_at,
  row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1)"""
)
VECTORS = "vec AS (SELECT vec_id, 'vec/' || label || '/' || vec_id AS path, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
VECTOR_WRITES = """cur AS (SELECT vec_id AS seq, 'vec/' || (vec_id // 20) || '/' || vec_id AS path, 'reading ' || (vec_id % 13) || ' from group ' || label || ' by sensor ' || (vec_id % 5) AS value,
  'agent-' || (vec_id // 7 % 3) AS owner, CASE vec_id % 2 WHEN 0 THEN 'fact' ELSE 'observation' END AS type, CAST(vec_id % 100 AS DOUBLE) / 100 AS confidence,
  CASE WHEN vec_id % 3 = 0 THEN ['vec/' || ((vec_id + 1) // 20) || '/' || (vec_id + 1)] ELSE CAST([] AS VARCHAR[]) END AS refs, 1704067200.0 + 60.0 * vec_id AS updated_at,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"""
TURNS = "turns AS (SELECT conv_id, turn, 'conv/' || conv_id || '/turn/' || turn AS path, text AS value, role AS owner FROM conversations)"
EDGES = """edges AS (SELECT 'order/' || o_orderkey AS child, 'customer/' || o_custkey AS parent FROM orders
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only write log; ``seq`` is the order of writing."""
    e, u = F.col("event_id"), F.col("user_id")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (e % n + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        join("task/", F.col("event_type"), "/u", u).alias("path"),
        join(F.col("event_type"), " value=", F.floor("value").cast("long")).alias("value"),
        join("agent-", e % 7).alias("owner"),
        pick(4, "fact", "decision", "plan", "observation").alias("type"),
        ((e % 100).cast("double") / 100).alias("confidence"),
        F.when(e % 3 == 0, F.array().cast("array<string>")).when(e % 3 == 1, F.array(join("task/error/u", u + 1))).otherwise(F.array(join("task/view/u", u % 20), join("task/click/u", u % 20))).alias("refs"),
        pick(3, "turn", "session", "persistent").alias("ttl"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1e6).alias("updated_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("vec/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("path"), "label", F.col("embedding").cast("array<double>").alias("v"))


def vector_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write log with vectors: one reading an embedding."""
    i = F.col("vec_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    place = lambda n: text("vec/", F.floor(n / 20).cast("long"), "/", n)
    return table(spark, sf_dir, "embeddings").select(
        i.alias("seq"), place(i).alias("path"), text("reading ", i % 13, " from group ", F.col("label"), " by sensor ", i % 5).alias("value"),
        text("agent-", F.floor(i / 7).cast("long") % 3).alias("owner"), F.when(i % 2 == 0, "fact").otherwise("observation").alias("type"), ((i % 100).cast("double") / 100).alias("confidence"),
        F.when(i % 3 == 0, F.array(place(i + 1))).otherwise(F.array().cast("array<string>")).alias("refs"), F.lit("persistent").alias("ttl"), (F.lit(1704067200.0) + 60.0 * i).alias("updated_at"),
        normalise(F.col("embedding").cast("array<double>")).alias("v"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/turn/"), F.col("turn").cast("string")).alias("path"), F.col("text").alias("value"), F.col("role").alias("owner"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child was derived from parent."""
    pair = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    return pair("orders", "order/", "o_orderkey", "customer/", "o_custkey").union(pair("customer", "customer/", "c_custkey", "nation/", "c_nationkey")).union(pair("nation", "nation/", "n_nationkey", "region/", "n_regionkey"))
