"""Globs, tokens and vectors on the cases that define them."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions import vectors as V
from marlstone.plans import retrieval

GLOBS = [
    ("task/auth", "task/auth", True), ("task/auth", "task/auth/jwt", False), ("task/*", "task/auth", True), ("task/*", "task/auth/jwt", False), ("task/*", "task", False), ("*/auth", "task/auth", True),
    ("*", "task", True), ("*", "task/auth", False), ("task/**", "task", True), ("task/**", "task/auth/jwt/key", True), ("task/**", "tasks/x", False), ("**", "a/b/c", True), ("**/auth", "auth", True),
    ("**/auth", "a/b/auth", True), ("**/auth", "a/deploy", False), ("a/**/s", "a/s", True), ("a/**/s", "a/b/c/s", True), ("a/**/s", "a/b/v", False), ("a/*/s", "a/b/c/s", False), ("", "", True), ("a.c", "abc", False), ("a*", "ab", False),
]


@pytest.mark.parametrize("pattern,path,want", GLOBS)
def test_glob(pattern, path, want):
    assert C.glob_matches(pattern, path) is want


def brute(pattern, path):
    def at(p, q):
        if not p:
            return not q
        if p[0] == "**":
            return at(p[1:], q) or (bool(q) and at(p, q[1:]))
        return bool(q) and (p[0] == "*" or p[0] == q[0]) and at(p[1:], q[1:])

    return at(pattern, path)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "**"]), min_size=1, max_size=5), st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=5))
def test_glob_like_brute_force(pattern, path):
    assert C.glob_matches("/".join(pattern), "/".join(path)) == brute(pattern, path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "*", "**"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "*", "**"]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=4))
def test_covers_is_sound(allowed, requested, path):
    if C.covers("/".join(allowed), "/".join(requested)) and brute(requested, path):
        assert brute(allowed, path)


def test_glob_column_pushes_its_prefix(spark, tmp_path):
    spark.createDataFrame([(p,) for _, p, _ in GLOBS] + [(None,)], "path string").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    for pattern in {g[0] for g in GLOBS}:
        want = sorted(p for _, p, _ in GLOBS if C.glob_matches(pattern, p))
        assert sorted(r.path for r in t.where(C.glob(F.col("path"), pattern)).collect()) == want
    plan = t.where(C.glob(F.col("path"), "task/**"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,task)" in plan


def test_micro_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.tokens_full(F.lit("a"), F.lit("hello"), F.lit("o"), F.lit(1.0))) == 7
    assert one(retrieval.recency(F.lit(0.0), F.lit(3600.0))) == 0.5
    assert [round(one(retrieval.reference(F.lit(n))), 4) for n in (0, 1, 10)] == [0.1, 0.5079, 1.0]
    assert one(C.domain(F.lit("a"))) == "a" and one(C.domain(F.lit("a/b/c"))) == "b" and one(C.prefix(F.lit("a"))) == ""
    assert [one(C.age_text(F.lit(float(s)))) for s in (5, 90, 7200, 172800)] == ["5s", "1.5m", "2.0h", "2.0d"]
    w = retrieval.Weights()
    q, n = w.adapted(True), w.adapted(False)
    assert [round(x, 2) for x in (q.recency, q.conf, q.sim, q.ref, n.recency, n.conf, n.sim, n.ref)] == [0.2, 0.2, 0.4, 0.2, 0.45, 0.2, 0.15, 0.2]
    with pytest.raises(ValueError):
        retrieval.Weights(0.9, 0.9, 0.9, 0.9)
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert [round(x, 4) for x in one(V.interpolate(a, b, 0.5))] == [0.7071, 0.7071]
    r = {k: one(v) for k, v in V.relation(V.cosine(a, b)).items()}
    assert r["cosine"] == 0 and r["angular_distance" if "angular_distance" in r else "angular_dist"] == round(math.pi / 2, 6) and r["independence"] == 1
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(V.normalise(zero)) == [0.0, 0.0] and one(V.cosine(zero, a)) == 0


def test_path_problems(spark):
    bad = {"": "empty", "/a": "outer slash", "a//b": "double slash", "a/../b": "dot dot", "a b": "characters", "x" * 513: "too long", "a\0b": "null byte"}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in [*bad, "ok/path-1.x_y"]], "p string").select("p", C.path_problem(F.col("p")).alias("x")).collect()}
    assert got == {**bad, "ok/path-1.x_y": None}


def test_packing_keeps_to_the_budget(spark):
    r = random.Random(1)
    rows = [(i, f"entry/{i}", "v" * r.randint(1, 400), "o", 0.5) for i in range(50)]
    t = spark.createDataFrame(rows, "rank int, path string, value string, owner string, confidence double")
    for budget in (0, 5, 60, 700, 100000):
        got = sorted(retrieval.packed(retrieval.with_tokens(t), budget).collect(), key=lambda x: x["rank"])
        used, want = 0, []
        for _, path, value, owner, _ in rows:
            sizes = [max(1, n // 4) for n in (len(path) + len(owner) + len(value) + 23, len(path) + min(len(value), 100) + 4, len(path))]
            fit = [s for s in sizes if used + s <= budget]
            if not fit:
                break
            used += fit[0]
            want.append((path, used))
        assert [(x.path, x.used) for x in got] == want
