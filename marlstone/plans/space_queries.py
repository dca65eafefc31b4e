"""Vector search, algebra and the geometry of the embedding space."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marlstone.functions import vectors as V
from marlstone.functions.checkpoint import durable
from marlstone.operators import compression, kernels, similarity
from marlstone.plans.registry import query
from marlstone.sources import adapters as A

PAIR = A.VECTORS + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS c, a.v AS va, b.v AS vb FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1)"
LABELLED = A.VECTORS + ", p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, list_dot_product(a.v, b.v) AS c, a.v AS va, b.v AS vb FROM vec a JOIN vec b ON a.label = b.label AND b.vec_id > a.vec_id)"


def _query_vector(spark, d, vec_id: int = 0) -> list[float]:
    return list(A.vectors(spark, d).where(F.col("vec_id") == vec_id).first().v)


def _pairs(spark, d):
    """Each row and the next: what two vectors are to each other is asked of pairs, and these are as many as the rows."""
    v = A.vectors(spark, d)
    x, y = v.alias("x"), v.alias("y")
    return x.join(y, F.col("y.vec_id") == F.col("x.vec_id") + 1).select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b"), F.col("x.v").alias("va"), F.col("y.v").alias("vb"))


@query(f"WITH {A.VECTORS} SELECT path, round(list_dot_product(v, (SELECT v FROM vec WHERE vec_id = 0)) / sqrt(list_dot_product(v, v) * (SELECT list_dot_product(v, v) FROM vec WHERE vec_id = 0)), 6) AS similarity FROM vec ORDER BY list_dot_product(v, (SELECT v FROM vec WHERE vec_id = 0)) / sqrt(list_dot_product(v, v) * (SELECT list_dot_product(v, v) FROM vec WHERE vec_id = 0)) DESC, path LIMIT 10")
def k3_topk(spark, d):
    return similarity.topk(A.vectors(spark, d), _query_vector(spark, d), 10).select("path", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTORS} SELECT path, round(s, 6) AS similarity FROM (SELECT path, list_dot_product(v, (SELECT v FROM vec WHERE vec_id = 0)) / sqrt(list_dot_product(v, v) * (SELECT list_dot_product(v, v) FROM vec WHERE vec_id = 0)) AS s FROM vec WHERE vec_id > 0 ORDER BY s DESC, path LIMIT 20) WHERE s >= 0.25")
def f5_threshold_after_k(spark, d):
    q = A.vectors(spark, d).where(F.col("vec_id") == 0).first()
    return similarity.topk(A.vectors(spark, d), q.v, 20, 0.25, exclude=(q.path,)).select("path", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTORS} SELECT vec_id, round(list_dot_product(v, (SELECT v FROM vec WHERE vec_id = 0)) / sqrt(list_dot_product(v, v) * (SELECT list_dot_product(v, v) FROM vec WHERE vec_id = 0)), 6) AS similarity FROM vec")
def v12_all_similarities(spark, d):
    return similarity.to_query(A.vectors(spark, d), _query_vector(spark, d)).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTORS} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, len(v) AS dim FROM vec")
def x22_norms(spark, d):
    return A.vectors(spark, d).select("vec_id", F.round(V.norm(V.normalise(F.col("v"))), 5).alias("norm"), F.size("v").cast("long").alias("dim"))


@query(f"WITH {PAIR} SELECT a, b, round(c, 6) AS cosine, round(acos(greatest(-1, least(1, c))), 6) AS angular_dist, round(abs(c), 6) AS projection, round(sqrt(greatest(0, 1 - c * c)), 6) AS residual, round(greatest(0, c), 6) AS parallelism, round(greatest(0, -c), 6) AS opposition, round(1 - abs(c), 6) AS independence FROM (SELECT a, b, c / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb)) AS c FROM p)")
def v2_relate(spark, d):
    p = _pairs(spark, d).withColumn("c", V.cosine(F.col("va"), F.col("vb")))
    return p.select("a", "b", *[v.alias(k) for k, v in V.relation(F.col("c")).items()])


@query(f"WITH {PAIR} SELECT a, b, round(greatest(0, c), 4) AS similarity, round(least(1, sqrt(greatest(0, 2 - 2 * c)) / sqrt(2)) * (1 - abs(c)), 4) AS complementary, 0.0::DOUBLE AS hierarchical, round(greatest(0, -c), 4) AS contradictory, round(greatest(0, 1 - abs(c) * 3), 4) AS independent FROM (SELECT a, b, c / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb)) AS c FROM p)")
def v11_kinship(spark, d):
    p = _pairs(spark, d).withColumn("c", V.cosine(F.col("va"), F.col("vb")))
    return p.select("a", "b", *[v.alias(k) for k, v in V.kinship(F.col("c")).items()])


@query(f"WITH {A.VECTORS}, unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec), s AS (SELECT a.vec_id AS a, b.vec_id AS b, acos(greatest(-1, least(1, list_dot_product(a.v, b.v)))) AS w, a.v AS va, b.v AS vb FROM unit a JOIN unit b ON b.vec_id = a.vec_id + 1) SELECT a, b, i - 1 AS dim, round((sin(w / 2) / sin(w)) * (va[i] + vb[i]), 5) + 0.0 AS x FROM s, LATERAL (SELECT unnest(range(1, 65)) AS i)")
def v4_slerp(spark, d):
    p = _pairs(spark, d).withColumn("m", V.interpolate(V.normalise(F.col("va")), V.normalise(F.col("vb")), 0.5))
    return p.select("a", "b", F.posexplode("m").alias("dim", "x")).select("a", "b", F.col("dim").cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("x"))  # no negative zero


@query(f"WITH {A.VECTORS}, q AS (SELECT list_transform(range(1, 65), lambda i: c.v[i] + b.v[i] - a.v[i]) AS t FROM vec a, vec b, vec c WHERE a.vec_id = 0 AND b.vec_id = 1 AND c.vec_id = 2) SELECT vec_id, round(list_dot_product(v, t) / sqrt(list_dot_product(t, t)), 6) AS similarity FROM vec, q")
def v8_analogy(spark, d):
    v = A.vectors(spark, d)
    at = lambda i: v.where(F.col("vec_id") == i).select(F.col("v").alias(f"v{i}"))
    q = at(0).crossJoin(at(1)).crossJoin(at(2)).select(V.analogy(F.col("v0"), F.col("v1"), F.col("v2")).alias("t"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.dot(F.col("v"), F.col("t")), 6).alias("similarity"))  # one row


CENTRE = A.VECTORS + """, u AS (SELECT label, unnest(range(1, 65)) AS dim, unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))) AS x, vec_id FROM vec),
m AS (SELECT label, dim - 1 AS dim, avg(x) AS m FROM u GROUP BY ALL), cen AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m)"""


@query(f"WITH {CENTRE} SELECT label, dim, round(x, 6) AS x FROM cen")
def v6_centroids(spark, d):
    return similarity.centroids(A.vectors(spark, d)).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query(f"WITH {LABELLED} SELECT label, round(avg(c / sqrt(list_dot_product(va, va) * list_dot_product(vb, vb))), 6) AS mean_similarity FROM p GROUP BY label")
def a12_mean_pairwise(spark, d):
    return similarity.mean_pairwise(A.vectors(spark, d)).select("label", F.round("mean_similarity", 6).alias("mean_similarity"))


CROSS = A.VECTORS + ", unit AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM vec), c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)"


@query(f"WITH {CROSS} SELECT round(avg(CASE WHEN m < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS isolation FROM (SELECT a, max(s) AS m FROM c GROUP BY a)")
def a13_isolation(spark, d):
    return similarity.isolation(A.vectors(spark, d)).select(F.round("isolation", 6).alias("isolation"))


@query(f"WITH {CROSS} SELECT a, b, round(s, 5) AS similarity FROM c WHERE a < b AND s >= 0.4")
def j11_similarity_join(spark, d):
    return similarity.pairs_over(A.vectors(spark, d), 0.4).withColumn("similarity", F.round("similarity", 5))


@query(f"WITH {CROSS} SELECT a, b, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM c) WHERE rank <= 5")
def j12_knn_graph(spark, d):
    return similarity.knn(A.vectors(spark, d), 5).select("a", "b", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CROSS}, g AS (SELECT a, max(s) AS m, count(*) FILTER (WHERE s > 0.7) / count(*) AS den FROM c WHERE b < a GROUP BY a) SELECT a AS vec_id, round(1 - greatest(0, m), 4) AS novelty, round(den, 4) AS density, round(acos(greatest(-1, least(1, m))), 4) AS nearest_distance, round((1 - greatest(0, m)) * (1 - den), 4) AS information_gain FROM g UNION ALL SELECT min(vec_id), 1.0, 0.0, 'Infinity'::DOUBLE, 1.0 FROM vec")
def v13_novelty(spark, d):
    return similarity.novelty(A.vectors(spark, d))


@query(f"WITH {CROSS}, n AS (SELECT * FROM (SELECT a, acos(greatest(-1, least(1, s))) AS d, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c) WHERE r <= 6 AND d > 1e-10), g AS (SELECT a, count(*) AS n, sum(ln(t / d)) AS s FROM (SELECT *, max(d) OVER (PARTITION BY a) AS t FROM n) GROUP BY a) SELECT round(median((n - 1) / s), 3) AS dimension FROM g WHERE n >= 2 AND s > 0")
def v18_intrinsic_dimension(spark, d):
    return similarity.intrinsic_dimension(A.vectors(spark, d)).select(F.round("dimension", 3).alias("dimension"))


@query(f"WITH {A.VECTORS}, m AS (SELECT vec_id, list_transform(v[1:16], lambda x: x / sqrt(list_dot_product(v[1:16], v[1:16]))) AS t FROM vec) SELECT vec_id, i - 1 AS dim, round(t[i], 6) AS x FROM m, LATERAL (SELECT unnest(range(1, 17)) AS i)")
def v23_truncated(spark, d):
    t = A.vectors(spark, d).select("vec_id", V.truncate(F.col("v"), 16).alias("t"))
    return t.select("vec_id", F.posexplode("t").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


SHORT = A.VECTORS + ", sh AS (SELECT vec_id, list_transform(v[1:4], lambda x: x / sqrt(list_dot_product(v[1:4], v[1:4]))) AS v FROM vec)"


@query(f"WITH {SHORT} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 4) AS similarity FROM sh a JOIN sh b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.85")
def j17_conflict_pairs(spark, d):
    """Pairs alike enough to be in conflict, of all rows, by the first four dimensions (whole vectors are never as alike here)."""
    v = A.vectors(spark, d)
    return similarity.pairs_over(v.withColumn("v", V.truncate(F.col("v"), 4)), 0.85).withColumn("similarity", F.round("similarity", 4))


@query()
def v1_compose(spark, d):
    def kernel(label, part, m):
        return [(label, mode, i, round(float(x), 6)) for mode in ("weighted_mean", "principal", "grassmann", "attentive") for i, x in enumerate(kernels.compose(m, mode=mode))]

    return kernels.by_group(A.vectors(spark, d), "label", kernel, "label int, mode string, dim int, x double")


@query()
def v3_projection(spark, d):
    def kernel(label, part, m):
        return [(label, int(i), round(kernels.project(v, m[:8])[1], 6)) for i, v in zip(part["vec_id"], m, strict=True)]

    return kernels.by_group(A.vectors(spark, d), "label", kernel, "label int, vec_id bigint, retained double")


@query()
def v5_decompose(spark, d):
    cen = similarity.centroids(A.vectors(spark, d)).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).collect()  # one row a label
    axes = {str(r.label): np.array([e.x for e in r.c]) for r in cen}

    @F.pandas_udf("string")
    def shares(v: pd.Series) -> pd.Series:
        return pd.Series([",".join(f"{k}={x}" for k, x in sorted(kernels.decompose(np.asarray(a, float), axes).items())) for a in v], dtype=object)

    return A.vectors(spark, d).select("vec_id", shares("v").alias("shares"))


@query()
def v7_complement(spark, d):
    def kernel(label, part, m):
        return [(label, i, round(float(x), 6)) for i, x in enumerate(kernels.complement(m[1:9], m[0]))]

    return kernels.by_group(A.vectors(spark, d), "label", kernel, "label int, dim int, x double")


@query()
def v9_alignment(spark, d):
    return similarity.alignments(A.vectors(spark, d))


@query()
def v16_principal_components(spark, d):
    _, ratios = similarity.principal(A.vectors(spark, d), 10)
    return spark.createDataFrame([(i, round(float(r), 6)) for i, r in enumerate(ratios)], "component int, explained double")


@query()
def v19_clusters(spark, d):
    def kernel(label, part, m):
        own = kernels.average_linkage(m, 0.3)
        out = []
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            if len(at) >= 3:
                r = kernels.region(m[at])
                out.append((label, int(part["vec_id"].iloc[at[0]]), r["n"], round(r["radius"], 6), round(r["variance"], 6), round(r["dimension"], 4)))
        return out

    return kernels.by_group(A.vectors(spark, d), "label", kernel, "label int, first bigint, n int, radius double, variance double, dimension double")


@query(f"WITH RECURSIVE {CROSS}, e AS (SELECT a, b FROM c WHERE s >= 0.45 UNION ALL SELECT vec_id, vec_id FROM vec), r(n, m) AS (SELECT a, b FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m) SELECT n AS node, min(m) AS component FROM r GROUP BY n")
def v19_linked_components(spark, d):
    return similarity.linked(A.vectors(spark, d), 0.45)


@query()
def v20_voids(spark, d):
    return similarity.voids(A.vectors(spark, d), least=0.36).withColumn("nearest", F.round("nearest", 6))


@query()
def v21_geodesic(spark, d):
    return similarity.geodesics(A.vectors(spark, d), 0).select(F.col("node").cast("long").alias("vec_id"), F.round("cost", 6).alias("distance"))


@query()
def v22_metrics(spark, d):
    v = A.vectors(spark, d)
    ratios = similarity.principal(v, 64)[1]
    whole = similarity.mean_pairwise(v.withColumn("all", F.lit(0)), "all").select("n", "mean_similarity")
    near = durable(similarity.knn(v, 6))
    return whole.crossJoin(similarity.isolation(v, near=near)).crossJoin(similarity.intrinsic_dimension(v, near=near)).select("n", F.round("mean_similarity", 6).alias("mean_similarity"), F.round("isolation", 6).alias("isolation"), F.round("dimension", 3).alias("dimension"), F.lit(round(similarity.coverage(ratios), 6)).alias("coverage"))


@query()
def x23_sign_fingerprints(spark, d):
    return similarity.sign_bits(A.vectors(spark, d)).select("vec_id", F.hex("bits").alias("bits"))


@query()
def j9_lsh_pairs(spark, d):
    return similarity.lsh_pairs(A.vectors(spark, d), 0.4).withColumn("similarity", F.round("similarity", 6))


@query()
def j10_near_duplicates(spark, d):
    planes = np.random.RandomState(42).randn(256, 64)
    return compression.near_pairs(A.vectors(spark, d), planes, 0.6).withColumn("similarity", F.round("similarity", 6))


@query()
def c4_same_vectors(spark, d):
    return compression.without_same_vectors(A.vectors(spark, d), threshold=0.4).select("vec_id", "label")


@query()
def k4_mmr(spark, d):
    return similarity.chosen_mmr(A.vectors(spark, d), _query_vector(spark, d), 10)


@query()
def k5_diverse_search(spark, d):
    return similarity.chosen_diverse(A.vectors(spark, d), _query_vector(spark, d), 10, 0.3)
