"""What grows with the input, on small tables: rows shuffled, sizes of plans, matrices and batches; and results that tiles must not change."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.checkpoint import durable
from marlstone.operators import compression, kernels, protocol, providers, reasoning, similarity, vectorstore
from marlstone.plans import catalog

from .test_queries import SF


def shuffled(spark, df) -> int:
    """Rows that a run of ``df`` writes to shuffles."""
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return {every.apply(i).stageId(): every.apply(i).shuffleWriteRecords() for i in range(every.size())}

    before = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in before)


def scattered(spark, n: int):
    """A log in which every path is written once, under many prefixes."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("seq"), F.concat(F.lit("t/"), (i % (n // 20)).cast("string"), F.lit("/"), i.cast("string")).alias("path"), F.concat(F.lit("v"), i.cast("string")).alias("value"),
        F.concat(F.lit("a"), (i % 7).cast("string")).alias("owner"), F.lit("fact").alias("type"), F.lit(0.5).alias("confidence"),
        F.array().cast("array<string>").alias("refs"), i.cast("double").alias("updated_at"),
    )


def test_contradictions_list_as_much_as_the_log(spark):
    """a row that stays current was listed in 256 parts under three ancestors."""
    log = scattered(spark, 400)
    found = reasoning.contradictions(log)
    assert found.count() == sum(1 for a in range(400) for b in range(a) if a % 20 == b % 20 and a % 7 != b % 7)
    assert shuffled(spark, found.select("seq", "old_seq")) < 25 * 400


def test_text_is_normalised_before_pairs_meet(spark):
    """the join normalised both texts of each pair."""
    plan = reasoning.contradictions(scattered(spark, 40))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join Inner" in x]
    assert joins and not any("regexp_replace" in x for x in joins)


def test_vectors_are_listed_as_often_as_the_log_has_writes(spark):
    """each vector was sent 256 times under three ancestors."""
    log = scattered(spark, 400).withColumn("v", F.array(F.lit(1.0), F.col("seq") / 400))
    found = reasoning.contradictions(log, threshold=0.05)
    assert found.count() == reasoning.contradictions(log.drop("v")).count() > 0
    assert shuffled(spark, found.select("seq", "old_seq")) < 50 * 400


def test_sizes_of_plans_do_not_grow_by_round(spark):
    """the estimated size of a checkpoint of joins had twice as many digits each round; the driver ran out of memory."""
    x = spark.range(9).toDF("a")
    for _ in range(8):
        x = durable(x.join(x.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a"))
    assert sorted(r.a for r in x.collect()) == list(range(9))
    assert x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 100


def vectors(spark, m):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.asarray(m, float))], "vec_id bigint, v array<double>")


def test_similarity_is_not_rounded_to_32_bits(spark):
    """vectors were cut to 32 bits, which moves pairs over the threshold."""
    rng = np.random.default_rng(3)
    turn = np.arccos(0.85) + np.where(np.arange(40) % 2, 1e-10, -1e-10)
    rows = []
    for t in turn:
        a, b = np.linalg.qr(rng.normal(size=(4, 2)))[0].T
        rows += [a, np.cos(t) * a + np.sin(t) * b]
    got = {(r.a, r.b) for r in similarity.pairs_over(vectors(spark, rows), 0.85).collect()}
    assert {p for p in got if p[1] == p[0] + 1 and p[0] % 2 == 0} == {(2 * i, 2 * i + 1) for i in range(0, 40, 2)}


#: Queries whose pairs of rows were made of joined blocks, many of which an Arrow batch held.
CELLS: list[str] = ["v13_novelty", "v22_metrics", "c4_same_vectors", "j12_knn_graph", "v18_intrinsic_dimension", "a13_isolation", "j10_near_duplicates", "v21_geodesic"]


@pytest.mark.parametrize("name", CELLS)
def test_rows_meet_in_cells(spark, name, monkeypatch):
    seen, real = [], similarity.cellwise

    def cellwise(*a, **k):
        out = real(*a, **k)
        seen.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(similarity, "cellwise", cellwise)
    catalog.queries()[name](spark, SF)
    assert len(seen) == 1 and "Join" not in seen[0] and "collect_list" not in seen[0]


def test_density_multiplies_matrices(spark):
    """each row met each vector of the context in interpreted expressions."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 8))
    rows = vectors(spark, m).unionByName(spark.createDataFrame([(60, None)], "vec_id bigint, v array<double>")).select(F.col("vec_id").cast("string").alias("path"), "v", F.concat(F.lit("text "), "vec_id").alias("value"), F.lit("o").alias("owner"), F.lit(0.0).alias("confidence"))
    out = compression.density(rows, rows.where("path IN ('3', '7', '60')"))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (u @ u[[3, 7]].T).max(axis=1)
    for r in out.collect():
        i = int(r.path)
        told = 0.5 * (i not in (3, 7, 60)) + 0.3 * (1.0 if i == 60 else max(0.0, 1 - near[i]))
        assert abs(r.density - told / max(1, (len(r.path) + 1 + len(r.value) + 23) // 4) * 100) < 1e-9
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def units(n: int, seed: int, copies: int = 0):
    m = np.random.default_rng(seed).normal(size=(n, 16))
    m[:copies] = m[n - copies :]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def peak_mb(f) -> float:
    tracemalloc.start()
    f()
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


@pytest.mark.parametrize("copies", [0, 30])
def test_average_linkage_merges_as_pair_by_pair(copies):
    m = units(150, 6, copies)
    s, parts = m @ m.T, [[i] for i in range(150)]
    while len(parts) > 1:
        top, i, j = max((s[np.ix_(p, q)].mean(), -i, -j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
        if top < 0.3:
            break
        parts[-i] += parts.pop(-j)
    own = kernels.average_linkage(m, 0.3)
    assert {tuple(np.flatnonzero(own == c).tolist()) for c in set(own.tolist())} == {tuple(sorted(p)) for p in parts}


def test_average_linkage_holds_no_matrix_of_all_rows():
    """it held the similarities of all rows of a label (288 MB here)."""
    assert peak_mb(lambda: kernels.average_linkage(units(6000, 8), 0.9)) < 150


def test_compositions_hold_no_matrix_of_all_rows():
    """F8: attention held the likeness of all rows of a label (288 MB here)."""
    m = units(6000, 9)
    assert peak_mb(lambda: [kernels.compose(m, mode=x) for x in ("weighted_mean", "principal", "grassmann", "attentive")]) < 40
    few = m[:200]
    agree = few @ few.T
    np.fill_diagonal(agree, 0)
    heat = agree.sum(1)
    out = np.exp(heat - heat.max()) @ few
    assert np.allclose(kernels.compose(few, mode="attentive"), out / np.linalg.norm(out))
    side = np.linalg.svd(few - few.mean(0) / len(few), full_matrices=False)[2][0]
    assert np.allclose(kernels.compose(few, mode="principal"), side * np.sign(side @ few.mean(0)))


def test_near_vectors_of_one_fingerprint_are_not_seen(spark):
    """a vector counted as seen where another only shared its fingerprint."""
    m = np.random.default_rng(2).normal(size=(1, 64))
    rows = vectors(spark, np.concatenate([m, m + 1e-6, m, 2 * m]))
    assert len({bytes(r.bits) for r in similarity.sign_bits(rows).collect()}) == 1
    assert {r.vec_id: r.seen for r in vectorstore.seen_before(rows, "vec_id").collect()} == {0: False, 1: False, 2: True, 3: True}


def alike(spark, n: int):
    """Texts that differ in a word, so that most fingerprints are near each other; every tenth is a copy of the one before."""
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(i, f"doc/{i}", "ab"[i % 2], f"{text} only{i - (i % 10 == 9)}") for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, path string, source string, content string")


def test_near_copies_send_rows_not_pairs(spark):
    """all pairs of near fingerprints were shuffled with their vectors."""
    out = protocol.near_copies(providers.embed(alike(spark, 300), providers.HashProvider(32), "content"))
    assert {(r.seq, r.copy_of) for r in out.collect()} == {(i, i - 1) for i in range(9, 300, 10)}
    assert shuffled(spark, out) < 30 * 300


def test_ingestion_sends_rows_not_pairs(spark):
    """ingestion looks for near copies, so it sent pairs of near fingerprints too."""
    rows = alike(spark, 300).withColumns({"tags": F.array("source"), "source_trust": F.lit(0.6)})
    out = protocol.ingest(rows, ["a", "b"], lambda x, text: providers.embed(x, providers.HashProvider(32), text))
    assert {r.derived_from for r in out.where("derived_from IS NOT NULL").collect()} == {f"doc/{i - 1}" for i in range(9, 300, 10)}
    assert shuffled(spark, out) < 40 * 300


#: Queries that fold a log in one task.
FOLDS = ["n7_trust_fold", "x19_trust_decay", "k6_trust_ranking", "n10_elo_fold"]


@pytest.mark.parametrize("name", FOLDS)
def test_folds_sort_spans_not_rows(spark, name):
    """The task that folds the log sorted all its rows."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [x for x in plan.split("\n") if "Sort [" in x and "], false" in x]  # of a partition
    assert any("span" in x for x in sorts) and not any("seq" in x for x in sorts)


