"""Operators against hand-made values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import compression, confidence, evaluation, kernels, protocol, provenance, providers, reasoning, similarity, store, trust
from marlstone.plans import catalog
from marlstone.sources import exchange
from marlstone.store import KnowledgeStore
from marlstone.streaming import events as E

LOG = "seq bigint, path string, value string, owner string, type string, confidence double, refs array<string>, ttl string, updated_at double"


def log(spark, rows):
    return spark.createDataFrame([(i + 1, p, v, o, t, c, list(r), "session", 100.0 * i) for i, (p, v, o, t, c, r) in enumerate(rows)], LOG)


def test_contradictions_only_with_rows_current_then(spark):
    w = log(spark, [("t/a", "yes", "x", "fact", 1.0, ()), ("t/b", "no", "y", "fact", 1.0, ()), ("t/a", "no", "x", "fact", 1.0, ()), ("t/c", "NO ", "z", "fact", 1.0, ()), ("alone", "q", "z", "fact", 1.0, ()), ("t/d", "yes", "y", "plan", 1.0, ("t/e",))])
    assert {(r.path, r.old_path) for r in reasoning.contradictions(w).collect()} == {("t/b", "t/a"), ("t/a", "t/b")} - {("t/a", "t/b")}
    assert [(r.plan_path, r.ref) for r in reasoning.gaps(w).collect()] == [("t/d", "t/e")]


def test_contradictions_of_the_whole_log(spark, tmp_path):
    rows = [(i, f"u{i % 5}", ("view", "click")[i % 2], i % 9) for i in range(60)]
    spark.sql("SELECT * FROM VALUES " + ",".join(f"(CAST({i} AS BIGINT), {u[1:]}L, '{t}', CAST({v} AS DOUBLE), TIMESTAMP_NTZ'2024-01-01 00:00:00')" for i, u, t, v in rows) + " AS e(event_id, user_id, event_type, value, ts)").write.parquet(f"{tmp_path}/events.parquet")
    log = [(i, f"task/{t}/{u}", f"{t} value={v}", i % 7, i % 4) for i, u, t, v in rows]
    want = set()
    for n, path, value, owner, kind in log:
        now = {p: (s, v, o, k) for s, p, v, o, k in log if s < n}  # the last write of each path
        want |= {(n, s, path, p) for p, (s, v, o, k) in now.items() if p != path and p.split("/")[1] == path.split("/")[1] and o != owner and k == kind and v != value}
    got = [tuple(r)[:4] for r in catalog.queries()["j3_contradictions"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({s % 7 for s, *_ in want}) == 7


def test_confidence_values(spark):
    ev = "seq bigint, path string, kind string, agent string, confidence double, strength double, ts double"
    e = spark.createDataFrame([(1, "x", "register", "a", 0.8, 1.0, 0.0), (2, "y", "register", "a", 0.8, 1.0, 0.0), (3, "y", "contradict", "b", None, 1.0, 0.0), (4, "z", "confirm", "b", None, 1.0, 0.0), (5, "w", "register", "a", 0.1, 1.0, 0.0), (6, "w", "contradict", "b", None, 1.0, 0.0), (7, "w", "register", "a", 0.5, 1.0, 0.0)], ev)
    got = {r.path: (round(r.alpha, 6), round(r.beta, 6), round(r.e, 6)) for r in confidence.states(e).withColumn("e", confidence.effective(F.col("alpha"), F.col("beta"), F.col("base"))).collect()}
    assert got == {"x": (1.8, 1.2, 0.78), "y": (1.8, 3.2, 0.668), "w": (1.5, 1.5, 0.5)}
    assert spark.range(1).select(confidence.decayed(F.lit(0.9), F.lit(7200.0)).alias("x")).first().x == pytest.approx(0.7)


def fold(spark, rows):
    ev = "seq bigint, kind string, actor string, target string, domain string, conf_actor double, conf_target double, ts double"
    return {r.agent: r for r in trust.fold(spark.createDataFrame([(i, *r, 0.0) for i, r in enumerate(rows)], ev)).collect()}


def test_trust_values(spark):
    t = fold(spark, [("confirmation", "b", "a", "d", 0.5, 0.5)])
    assert round(t["a"].trust, 4) == 0.66 and round(t["b"].trust, 4) == 0.58 and round(t["a"].domains["d"], 4) == 0.66
    t = fold(spark, [("contradiction", "b", "a", "d", 0.5, 0.5)])
    assert round(t["a"].trust, 4) == round(t["b"].trust, 4) == 0.436 and round(t["a"].domains["d"], 4) == 0.18
    t = fold(spark, [("contradiction", "b", "a", "d", 0.9, 0.5)])
    assert round(t["b"].trust, 4) == 0.596 and round(t["a"].trust, 4) == 0.18
    t = fold(spark, [("contradiction", "b", "a", "d", 0.9, 0.5)] * 9 + [("confirmation", "b", "a", "d", 0.5, 0.5)] * 30)
    assert all(0 <= r.trust <= 1 for r in t.values())


def test_pagerank_like_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.random((6, 6)) * (1 - np.eye(6))
    e = spark.createDataFrame([(str(i), str(j), float(m[i, j])) for i in range(6) for j in range(6) if m[i, j]], "actor string, target string, weight double")
    n = m / m.sum(0)
    s = np.ones(6) / 6
    for _ in range(20):
        new = 0.15 / 6 + 0.85 * n.T @ s
        done = np.linalg.norm(new - s) < 1e-6
        s = new
        if done:
            break
    got = {r.agent: r.score for r in trust.pagerank(e).collect()}
    assert all(abs(got[str(i)] - s[i] / s.max()) < 1e-9 for i in range(6))


def test_walk_takes_least_depth_and_stops_in_cycles(spark):
    e = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "b"), ("a", "d")], "child string, parent string")
    got = {r.node: r.depth for r in provenance.walk(e, spark.createDataFrame([("d",)], "start string")).collect()}
    assert got == {"d": 0, "b": 1, "c": 1, "a": 2}
    assert provenance.chain(e.where("child <> 'a'"), "a", "c") in (["a", "b", "c"],) and provenance.chain(e, "a", "zz") is None


def test_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "vec_id bigint, v array<double>")
    s = m @ m.T
    assert {(r.a, r.b) for r in similarity.pairs_over(t, 0.5).collect()} == {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    old, similarity.BLOCK_ROWS = similarity.BLOCK_ROWS, 7
    np.fill_diagonal(s, -2)
    near = {(r.a, r["rank"]): r.b for r in similarity.knn(t, 3).collect()}
    similarity.BLOCK_ROWS = old
    assert all(near[i, k + 1] == np.argsort(-s[i])[k] for i in range(60) for k in range(3))
    n, mean, cov = similarity.moments(t)
    assert n == 60 and np.allclose(mean, m.mean(0)) and np.allclose(cov, np.cov(m.T))
    assert [r.vec_id for r in similarity.topk(t, list(m[3]), 2, tie="vec_id").collect()] == [3, int(np.argmax(s[3]))]


def test_lsh_pairs_recall(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(400, 64))
    m[200:] = m[:200] + rng.normal(size=(200, 64)) * rng.uniform(0.3, 2.2, (200, 1))  # cosines from 0.96 to 0.4
    t = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)], "vec_id bigint, v array<double>").cache()
    packed = {r.vec_id: np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in similarity.sign_bits(t).collect()}
    codes = np.stack([packed[i] for i in range(400)]).astype(int)
    sims = np.cos(np.pi * (codes[:, None] != codes[None]).sum(axis=2) / 256)
    old, similarity.BLOCK_ROWS = similarity.BLOCK_ROWS, 90
    found = {(r.a, r.b): r.similarity for r in similarity.lsh_pairs(t, 0.4).collect()}
    near = {(r.a, r.b) for r in similarity.pairs_over(t, 0.55).collect()}
    similarity.BLOCK_ROWS = old
    assert set(found) == {(i, j) for i in range(400) for j in range(i + 1, 400) if sims[i, j] >= 0.4}
    assert all(math.isclose(found[p], sims[p]) for p in found)
    assert len(near & set(found)) >= 0.9 * len(near) > 90


def test_kernels():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(12, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for mode in ("weighted_mean", "principal", "grassmann", "attentive"):
        assert abs(np.linalg.norm(kernels.compose(m, mode=mode)) - 1) < 1e-9
    same = np.repeat(m[:1], 4, axis=0)
    assert np.allclose(kernels.compose(same, mode="grassmann"), m[0]) and kernels.alignment(m, m) == 1.0
    p, kept = kernels.project(m[0], m[:3])
    assert np.allclose(p, m[0]) and abs(kept - 1) < 1e-9 and abs(kernels.complement(m[:3], m[5]) @ m[1]) < 1e-9
    two = np.concatenate([np.eye(6)[:1] + 0.02 * rng.normal(size=(5, 6)), np.eye(6)[3:4] + 0.02 * rng.normal(size=(5, 6))])
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    assert len(set(kernels.average_linkage(two))) == 2 and kernels.geodesic(two, 0, 7, 3) is None
    assert kernels.geodesic(m, 0, 0) == 0 and kernels.mmr([1.0, 0.9, 0.1], [m[0], m[0], m[1]], 2)[0] == 0
    with pytest.raises(ValueError):
        kernels.compose(m, mode="none")
    sims = m @ m.T
    chosen = [0]
    rel = list(m @ m[0])
    while len(chosen) < 5:
        value = {i: 0.7 * rel[i] - 0.3 * max(sims[i, j] for j in chosen) for i in range(12) if i not in chosen}
        chosen.append(max(value, key=value.get))
    assert kernels.mmr(rel, list(m), 5) == chosen


def test_delta_and_duplicates(spark):
    rows = spark.createDataFrame([("a", "x", 2, 1), ("b", "y", 1, 2), ("c", "z", 1, 3), ("d", "x", 1, 4)], "path string, value string, version int, seq int")
    seen = rows.where("path in ('a', 'b')").select("path", F.lit(1).alias("version"), F.substring(F.md5("value"), 1, 16).alias("value_hash"))
    assert {r.path: r.delta for r in compression.delta(rows, seen).collect()} == {"a": "updated", "b": "unchanged", "c": "new", "d": "unchanged"}
    assert {r.path for r in compression.without_same_text(rows).collect()} == {"a", "b", "c"}


def test_protocol_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(protocol.elo_expected(F.lit(1500.0), F.lit(1500.0))) == 0.5
    r = {x.agent: x.rating for x in protocol.elo(spark.createDataFrame([(1, "a", "b")], "seq int, winner string, loser string")).collect()}
    assert r == {"a": 1516.0, "b": 1484.0}
    assert one(protocol.lazy_decay(F.lit(0.8), F.lit(10.0), 10.0)) == pytest.approx(0.4) and one(protocol.near_in_time(F.lit(0.0), F.lit(86400.0))) == pytest.approx(math.exp(-1))
    assert one(evaluation.token_f1(F.lit("The cat sat"), F.lit("a cat ran"))) == 0.5 and one(evaluation.exact_match(F.lit("The Cat!"), F.lit("cat"))) == 1.0


def test_store_round_trip(spark, tmp_path):
    kb = KnowledgeStore(spark, str(tmp_path / "log"))
    assert kb.current().count() == 0 and not kb.exists("a/b")
    kb.put("a/b", "one", "x", now=1.0)
    kb.put("a/b", "two", "y", now=2.0, ttl="turn")
    kb.put("a/c", "three", "x", type="plan", refs=["a/zz"], now=3.0)
    row = kb.retrieve("a/b").first()
    assert (row.value, row.version, row.created_at) == ("two", 2, 1.0) and kb.get("a/**", 1000).count() == 2
    assert kb.gaps().first().ref == "a/zz" and kb.status().first().entries == 2 and kb.lineage("a/b").count() == 2
    assert [r.path for r in kb.clear_turn().collect()] == ["a/b"] and not kb.exists("a/b")
    kb.put("a/b", "again", "x", now=9.0)
    assert kb.retrieve("a/b").first().version == 1
    with pytest.raises(ValueError):
        kb.put("/bad", "v", "o")


def test_json_round_trip(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"entries": [{"path": "a/b", "value": "v"}, {"path": "c", "value": "w", "owner": "o", "refs": ["x"], "metadata": {"k": "1"}}]}')
    got = exchange.import_json(spark, str(tmp_path / "in.json"))
    exchange.export_json(got, str(tmp_path / "out"))
    back = {r.path: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["a/b"].type == "fact" and back["a/b"].ttl == "session" and back["c"].refs == ["x"]


def test_stream_equals_batch(spark, tmp_path):
    w = log(spark, [("t/a", "yes", "x", "fact", 1.0, ()), ("t/b", "no", "y", "fact", 1.0, ()), ("u/c", "no", "x", "fact", 1.0, ())])
    w.write.parquet(str(tmp_path / "log"))
    seen, stream = [], E.change_events(E.log_stream(spark, str(tmp_path / "log"), LOG))
    q = E.subscribe(stream, "t/*", lambda d, _: seen.extend(r.path for r in d.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["t/a", "t/b"]
    m = E.matching(E.change_events(w), {"one": "t/*", "all": "**"}).collect()
    assert sorted((r.subscriber, r.path) for r in m) == [("all", "t/a"), ("all", "t/b"), ("all", "u/c"), ("one", "t/a"), ("one", "t/b")]


def test_limits_and_breaker(spark):
    r = spark.createDataFrame([("k", 0.0)] * 5 + [("k", 1.0)] * 3, "key string, ts double")
    assert sorted((x.ts, x.allowed) for x in E.rate_limited(r, rate=2, burst=3).collect()) == [(0.0, False)] * 2 + [(0.0, True)] * 3 + [(1.0, False)] + [(1.0, True)] * 2
    c = spark.createDataFrame([("p", float(i), False) for i in range(5)] + [("p", 10.0, True), ("p", 70.0, True), ("p", 71.0, True)], "provider string, ts double, ok boolean")
    assert [x.state for x in sorted(E.breaker_states(c).collect(), key=lambda x: x.ts)] == ["closed"] * 5 + ["open", "half_open", "closed"]


def test_empty_log(spark):
    none = log(spark, []) if False else spark.createDataFrame([], LOG)
    for f in (store.latest, store.versions, reasoning.contradictions, reasoning.gaps, reasoning.cross_agent, reasoning.summaries, provenance.nodes):
        assert f(none).count() == 0
    assert trust.fold(reasoning.cross_agent(none)).count() == 0


def test_contradictions_by_vectors_and_by_text(spark):
    schema = "seq bigint, path string, value string, owner string, type string, confidence double, refs array<string>, ttl string, updated_at double, v array<double>"
    rows = [(1, "t/a", "x", "p", "fact", 1.0, [], "session", 1.0, [1.0, 0.0]), (2, "t/b", "y", "q", "plan", 1.0, [], "session", 2.0, [0.9, 0.1]), (3, "t/c", "z", "r", "fact", 1.0, [], "session", 3.0, None), (4, "t/d", "w", "q", "fact", 1.0, [], "session", 4.0, [0.0, 1.0])]
    log = spark.createDataFrame(rows, schema)
    got = {(r.seq, r.old_seq, round(r.similarity, 2)) for r in reasoning.contradictions(log).collect()}
    assert got == {(2, 1, 0.99), (3, 1, 0.5), (4, 3, 0.5)}
    assert {r.seq for r in reasoning.contradictions(log, new=log.where("seq = 3")).collect()} == {3}


def test_state_round_trip(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert exchange.load_state(spark, folder, "trust") is None
    exchange.save_state(spark, folder, "trust", {"b": [1, 2], "a": {"x": 0.5}})
    exchange.save_state(spark, folder, "trust", {"b": 3})
    assert exchange.load_state(spark, folder, "trust") == {"b": 3} and exchange.load_state(spark, folder, "none") is None
    spark.createDataFrame([("bad", "{no json", 9)], "key string, payload string, at bigint").write.mode("append").parquet(folder)
    assert exchange.load_state(spark, folder, "bad") is None
    n = provenance.nodes(log(spark, [("t/a", "1", "x", "fact", 1.0, ()), ("t/a", "2", "x", "fact", 1.0, ())]))
    exchange.save_table(n, str(tmp_path / "graph"))
    assert sorted(map(str, exchange.load_table(spark, str(tmp_path / "graph")).collect())) == sorted(map(str, n.collect()))


def test_question_sets_settings_and_capabilities(spark, tmp_path, monkeypatch):
    (tmp_path / "q.json").write_text('{"id": "1", "context": "long", "question": "q?"}\n')
    assert exchange.long_questions(spark, str(tmp_path / "q.json")).first().asDict() == {"id": "1", "context": "long", "question": "q?", "answer": "", "length": "", "difficulty": ""}
    (tmp_path / "h.json").write_text('{"id": "1", "question": "q", "answer": "a", "context": {"title": ["T", "U"], "sentences": [["x.", "y."], ["z."]]}}\n')
    assert exchange.questions(spark, str(tmp_path / "h.json")).first().context == "T: x. y.\n\nU: z."
    (tmp_path / "s.json").write_text('{"a": 1, "b": 2}')
    monkeypatch.setenv("MARLSTONE_B", "3")
    assert exchange.settings(str(tmp_path / "s.json"), a=None, c=4) == {"a": 1, "b": "3", "c": 4}
    assert [r.channel for r in exchange.capabilities(spark, True).where("best").collect()] == ["embedding"]


def test_merges_draws_and_dimensions(spark):
    n = provenance.nodes(log(spark, [("t/a", "1", "x", "fact", 1.0, ()), ("t/b", "2", "x", "fact", 1.0, ())]))
    ev = spark.createDataFrame([(10, "merge", "t/c", "z", "h", ["t/a", "t/b", "t/none"]), (11, "confirm", "t/none", "z", "h", [])], "seq bigint, kind string, path string, owner string, value_hash string, sources array<string>")
    first = n.agg(F.min("seq")).first()[0]
    made = [r for r in provenance.recorded(n, ev).collect() if r.derivation == "merged"]
    assert len(made) == 1 and made[0].parents == [first, first + 1] and provenance.recorded(n, ev).count() == 3
    m = spark.createDataFrame([(1, "a", "b", False), (2, "b", "a", True)], "seq bigint, winner string, loser string, draw boolean")
    r = {x.agent: x.rating for x in protocol.elo(m).collect()}
    assert abs(sum(r.values()) - 3000) < 1e-9 and 1500 < r["a"] < 1516
    assert spark.range(1).select(providers.likeness({"confidence": (F.lit(0.9), F.lit(0.4), 1.0), "relational": (F.lit(1.0), F.lit(0), 3.0)}).alias("x")).first().x == pytest.approx(0.5)
    assert protocol.normalised_weights({"a": 2, "b": 6}) == {"a": 0.25, "b": 0.75}
