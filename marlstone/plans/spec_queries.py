"""Queries of the protocol-only operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import protocol as P
from marlstone.operators import store
from marlstone.plans.registry import query
from marlstone.sources import adapters as A

NOW = ", now AS (SELECT max(updated_at) AS t FROM cur)"


def _aged(spark, d):
    rows = store.latest(A.writes(spark, d))
    return rows.crossJoin(F.broadcast(rows.agg(F.max("updated_at").alias("t")))).withColumn("age", F.col("t") - F.col("updated_at"))  # one row


@query(f"WITH {A.CURRENT}{NOW} SELECT path, round(exp(-(t - updated_at) / 86400), 6) AS temporal, round(greatest(0.01, confidence * pow(2.0, -(t - updated_at) / 604800)), 6) AS decayed, round(greatest(0, 1 - 0.1 * log2(1 + (t - updated_at) / 86400)), 6) AS penalty FROM cur, now")
def x29_lazy_decay(spark, d):
    return _aged(spark, d).select("path", F.round(P.near_in_time(F.col("t"), F.col("updated_at")), 6).alias("temporal"), F.round(P.lazy_decay(F.col("confidence"), F.col("age"), 604800.0), 6).alias("decayed"), F.round(P.prediction_penalty(F.col("age") / 86400), 6).alias("penalty"))


@query(f"WITH {A.CURRENT}{NOW} SELECT path, round(greatest(0, least(1, 0.45 * 0.5 + 0.25 * confidence + 0.20 * 0.5 + 0.10 * exp(-(t - updated_at) / 86400))), 6) AS score FROM cur, now")
def x28_composite_score(spark, d):
    s = P.composite(F.lit(0.5), F.col("confidence"), F.lit(0.5), P.near_in_time(F.col("t"), F.col("updated_at")))
    return _aged(spark, d).select("path", F.round(s, 6).alias("score"))


@query("SELECT c_custkey, round(1 / (1 + pow(10.0, (1500 - (1500 + c_acctbal / 10)) / 400)), 6) AS expected, round(greatest(0.05, least(0.99, 1 / (1 + pow(10.0, (1500 - (1500 + c_acctbal / 10)) / 400)))), 6) AS trust FROM customer")
def x30_elo_step(spark, d):
    r = F.lit(1500.0) + F.col("c_acctbal") / 10
    return A.table(spark, d, "customer").select("c_custkey", F.round(P.elo_expected(r, F.lit(1500.0)), 6).alias("expected"), F.round(P.elo_trust(r), 6).alias("trust"))


@query()
def n10_elo_fold(spark, d):
    w = A.writes(spark, d).select("seq", F.col("owner").alias("winner"), F.concat(F.lit("agent-"), (F.col("seq") * 3 % 7).cast("string")).alias("loser")).where("winner <> loser")
    return P.elo(w).select("agent", F.round("rating", 6).alias("rating"))


PAIRS = A.CURRENT + ", q AS (SELECT a.path AS a, b.path AS b, a.confidence AS ac, b.confidence AS bc, (a.seq % 10) / 10.0 AS ta, (b.seq % 10) / 10.0 AS tb, a.updated_at AS au, b.updated_at AS bu FROM cur a JOIN cur b ON split_part(a.path, '/', 3) = split_part(b.path, '/', 3) AND a.path < b.path)"


@query(f"WITH {PAIRS} SELECT a, b, CASE WHEN ac - bc > 0.1 THEN 'a' WHEN bc - ac > 0.1 THEN 'b' WHEN ta - tb > 0.1 THEN 'a' WHEN tb - ta > 0.1 THEN 'b' WHEN au > bu THEN 'a' WHEN bu > au THEN 'b' END AS winner, CASE WHEN abs(ac - bc) > 0.1 THEN 'confidence' WHEN abs(ta - tb) > 0.1 THEN 'trust' WHEN au <> bu THEN 'recency' ELSE 'manual' END AS rule FROM q")
def p3_conflict_resolution(spark, d):
    c = store.latest(A.writes(spark, d)).select("path", "confidence", ((F.col("seq") % 10).cast("double") / 10).alias("trust"), F.col("updated_at").alias("at"), F.split_part("path", F.lit("/"), F.lit(3)).alias("u"))
    side = lambda s: c.select("u", *[F.col(x).alias(f"{s}_{x}") for x in ("path", "confidence", "trust", "at")])
    pairs = side("a").join(side("b"), "u").where("a_path < b_path")
    return P.resolve(pairs).select(F.col("a_path").alias("a"), F.col("b_path").alias("b"), "winner", "rule")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), h AS (SELECT doc_id, len(ws) AS l, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, (VALUES ('the'), ('ander'), ('data')) t(term)),
df AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS bm25 FROM h JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id""")
def x31_bm25(spark, d):
    return P.bm25(A.table(spark, d, "documents"), ["the", "ander", "data"]).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {A.CURRENT} SELECT owner, round(CAST(sum(confidence) + 1 AS DOUBLE), 9) AS alpha FROM (SELECT owner, round(confidence * 100) / 100 AS confidence FROM cur) GROUP BY owner")
def a21_beta_aggregation(spark, d):
    return store.latest(A.writes(spark, d)).groupBy("owner").agg((F.sum("confidence") + 1).alias("alpha")).withColumn("alpha", F.round("alpha", 9))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(lower(trim(role))))), ',') AS tags FROM conversations GROUP BY conv_id")
def x32_normalised_tags(spark, d):
    return A.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r")).select("conv_id", F.array_join(P.tags(F.col("r")), ",").alias("tags"))


@query("SELECT doc_id, i AS chunk, i * 448 AS first FROM (SELECT doc_id, length(text) // 4 AS n FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(0, CAST(floor(greatest(0, n - 65) / 448.0) AS BIGINT) + 1)) AS i)")
def x33_token_windows(spark, d):
    n = F.floor(F.length("text") / 4)
    return A.table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(P.token_windows(n)).alias("chunk")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * 448).cast("long").alias("first"))
