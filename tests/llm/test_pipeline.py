"""The pipeline against its stages applied by brute force, and that each stage's decisions take effect."""

from collections import Counter

import corpus_pipeline
from marlstone.llm import simhashgraph

from .conftest import SCHEMA, prose, row
from .test_operators import brute_contaminated, brute_repeats, toxic_corpus


def test_run(spark, tmp_path):
    rows, truth = toxic_corpus()
    shared = prose(7000, 70)
    item = " ".join(prose(7001, 40).split())
    extra = [row(500, rows[1][1]), row(501, prose(7002, 50) + " " + shared), row(502, shared + " " + prose(7003, 50)), row(503, prose(7004, 30) + " " + item + " " + prose(7005, 30)), row(504, None), row(None, prose(7006, 40)), row(505, "")]
    known = [(i, 1, int(truth[i])) for i in range(400)]
    d = str(tmp_path)
    spark.createDataFrame(rows + extra, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(known, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    ids = Counter(r.doc_id for r in out)
    assert set(ids) == {i for i in range(400) if not truth[i]} | {501, 502, 504, 505, None}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d)
        assert after.columns == docs.columns, name
        docs = after
    left = [tuple(r) for r in docs.collect()]
    assert not brute_repeats(left, 50) and not brute_contaminated(left, [(1, item)], 0.6)
    assert {r[0] for r in left} == set(ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_stages_handle_awkward_tables(spark, docs, rows, labels, benchmark, clashing, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names through all stages, and empty
    tables."""
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    benchmark.write.parquet(f"{d}/benchmark.parquet")
    at, among = docs, clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at, among = stage(spark, at, d), stage(spark, among, d)
        assert among.columns == clashing.columns, name
        assert Counter(str(tuple(r)) for r in at.collect()) == Counter(str(tuple(r)[: len(docs.columns)]) for r in among.collect()), name
        assert stage(spark, docs.limit(0), d).collect() == [] and stage(spark, docs.limit(0), d).columns == docs.columns, name
        at, among = (x.write.mode("overwrite").parquet(f"{d}/{k}") or spark.read.parquet(f"{d}/{k}") for k, x in ((f"{name}-a", at), (f"{name}-b", among)))
    ids = Counter(r.doc_id for r in at.collect())
    assert ids[None] == ids[60] == ids[61] == ids[62] == ids[63] == ids[1] == ids[4] == 1 and not ids[2] and not ids[3] and not ids[25]
    last = corpus_pipeline.STAGES[-1][1]
    assert {r.doc_id for r in last(spark, among, d).collect()} == set(ids) and last(spark, docs.limit(0), d).collect() == []
    none = f"{d}/none"
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.limit(0).write.parquet(f"{none}/{name}.parquet")
    assert corpus_pipeline.run(spark, none).collect() == []


def test_near_duplicates_stage_sends_no_node_to_every_shard(spark, monkeypatch):
    """A crowd, of which the least stays, and single texts, without the graphs in which every node meets every shard."""

    def everywhere(*_, **__):
        raise AssertionError("every node as a query in every shard")

    monkeypatch.setattr(simhashgraph, "candidate_edges", everywhere)
    words = prose(70_000, 180).split()
    crowd = [row(100 + i, " ".join([*words[:i], f"w{i}", *words[i + 1 :]])) for i in range(60)]
    single = [row(i, prose(80_000 + i, 120)) for i in range(20)]
    docs = spark.createDataFrame([*crowd, *single], SCHEMA).repartition(4)
    left = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates_out(spark, docs, "").collect())
    assert left == [*range(20), 100]
