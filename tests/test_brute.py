"""Queries that SQL cannot state, against plain Python and numpy over the same tables."""

import hashlib
import math
import re
import struct
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from marlstone.plans import catalog
from marlstone.sources import adapters as A

from .test_queries import SF, TABLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def vectors(db):
    rows = db.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall()
    m = np.array([r[2] for r in rows], float)
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def log(db):
    """The write log in order, as dicts."""
    cur = db.execute(f"WITH {A.WRITES} SELECT * FROM writes ORDER BY seq")
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def got(spark, name):
    return [r.asDict() for r in catalog.queries()[name](spark, SF).collect()]


def keyed(rows, *keys):
    out = {tuple(r[k] for k in keys): {k: v for k, v in r.items() if k not in keys} for r in rows}
    assert len(out) == len(rows)
    return out


def close(a, b, tol=2e-5):
    assert a.keys() == b.keys()
    for k in a:
        for c in b[k]:
            x, y = a[k][c], b[k][c]
            assert x == y or (isinstance(y, float) and x is not None and abs(x - y) <= tol * max(1, abs(y))), (k, c, x, y)


def cross(log):
    last, out = {}, []
    norm = lambda s: s.strip().lower()
    for w in log:
        old = last.get(w["path"])
        if old and old["owner"] != w["owner"]:
            out.append((w["path"].split("/")[1], norm(w["value"]) == norm(old["value"]), w["owner"], old["owner"], w["confidence"], old["confidence"], w["updated_at"]))
        last[w["path"]] = w
    return out


def trust(log):
    t, dom, n_dom, yes, no, n, at = defaultdict(lambda: 0.5), {}, Counter(), Counter(), Counter(), Counter(), {}
    cut = lambda x: min(1.0, max(0.0, x))
    for d, same, actor, target, ca, ct, ts in cross(log):
        t[actor], t[target]
        if same:
            step = 32 * (1 - 1 / (1 + math.exp(-4 * (t[target] - 0.5)))) / 100
            t[target] = cut(t[target] + step)
            t[actor] = cut(t[actor] + step / 2)
            dom[target, d] = cut(dom.get((target, d), 0.5) + step)
            yes[target] += 1
        else:
            if ca == ct:
                t[actor], t[target] = cut(t[actor] - 0.064), cut(t[target] - 0.064)
            else:
                win, lose = (actor, target) if ca > ct else (target, actor)
                t[win], t[lose] = cut(t[win] + 0.096), cut(t[lose] - 0.32)
            dom[target, d] = cut(dom.get((target, d), 0.5) - 0.32)
            no[target] += 1
        n_dom[target, d] += 1
        for x in (actor, target):
            n[x] += 1
            at[x] = max(at.get(x, 0.0), ts)
    return t, dom, n_dom, yes, no, n, at


def for_domain(state, agent, domain):
    t, dom, n_dom = state[:3]
    w = min(1.0, n_dom[agent, domain] / 10)
    return (1 - w) * t[agent] + w * dom.get((agent, domain), t[agent])


def brute_n7_trust_fold(spark, log):
    t, _, _, yes, no, n, at = trust(log)
    close(keyed(got(spark, "n7_trust_fold"), "agent"), {(a,): {"trust": t[a], "confirmations": yes[a], "contradictions": no[a], "interactions": n[a], "last_active": at[a]} for a in t})


def brute_k6_trust_ranking(spark, log):
    state = trust(log)
    rows = got(spark, "k6_trust_ranking")
    close(keyed(rows, "agent"), {(a,): {"trust": for_domain(state, a, "error")} for a in state[0]})
    assert [-r["trust"] for r in rows] == sorted(-r["trust"] for r in rows)


def brute_x19_trust_decay(spark, log):
    t, dom, _, _, _, _, at = trust(log)
    now = max(w["updated_at"] for w in log)
    fade = lambda x, a: 0.5 + (x - 0.5) * math.exp(-(now - at[a]) / 86400)
    rows = keyed(got(spark, "x19_trust_decay"), "agent")
    close({k: {"trust": v["trust"]} for k, v in rows.items()}, {(a,): {"trust": fade(t[a], a)} for a in t})
    for (a,), r in rows.items():
        told = {k: float(v) for k, v in (x.split("=") for x in r["domains"].split(",") if x)}
        assert told.keys() == {d for b, d in dom if b == a} and all(abs(v - fade(dom[a, d], a)) < 1e-4 for d, v in told.items())


def brute_j6_confidence_signal(spark, log):
    state, now, paths = trust(log), max(w["updated_at"] for w in log), {}
    for w in log:
        p = paths.get(w["path"])
        if p is None:
            p = paths[w["path"]] = {"a": 1 + w["confidence"], "b": 2 - w["confidence"], "base": w["confidence"]}
        elif p["owner"] == w["owner"]:
            p["base"] = w["confidence"]
        elif p["value"].strip().lower() == w["value"].strip().lower():
            p["a"] += 1
        else:
            p["b"] += 2
        p |= {"owner": w["owner"], "value": w["value"], "at": w["updated_at"]}
    want = {}
    for path, p in paths.items():
        s = min(1.0, (p["a"] + p["b"] - 2) / 10)
        eff = (1 - s) * p["base"] + s * p["a"] / (p["a"] + p["b"])
        bayes = 0.5 + (eff - 0.5) * 2 ** (-(now - p["at"]) / 7200)
        t = for_domain(state, p["owner"], path.split("/")[1]) if p["owner"] in state[0] else 0.5
        want[path,] = {"signal": bayes * (0.6 + 0.4 * t)}
    close(keyed(got(spark, "j6_confidence_signal"), "path"), want)


def brute_n10_elo_fold(spark, log):
    r = defaultdict(lambda: 1500.0)
    for w in log:
        a, b = w["owner"], f"agent-{w['seq'] * 3 % 7}"
        if a != b:
            step = 32 * (1 - 1 / (1 + 10 ** ((r[b] - r[a]) / 400)))
            r[a], r[b] = r[a] + step, r[b] - step
    close(keyed(got(spark, "n10_elo_fold"), "agent"), {(a,): {"rating": x} for a, x in r.items()})


def brute_x34_paragraph_chunks(spark, db):
    want = {}
    for i, text in db.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        chunks, cur = [], ""
        for line in (x for x in text.split("\n") if x.strip(" ")):
            joined = f"{cur}\n{line}" if cur else line
            if cur and len(joined) > 2000:
                chunks.append(cur)
                joined = f"{cur[-300:]}\n{line}"
            cur = joined
        for k, c in enumerate([*chunks, cur] if cur else chunks):
            want[i, k] = {"n_chars": len(c)}
    close(keyed(got(spark, "x34_paragraph_chunks"), "doc_id", "chunk"), want)


def brute_v1_compose(spark, vectors):
    """Each mode by its definition, label by label."""
    ids, labels, m = vectors
    rows = defaultdict(dict)
    for r in got(spark, "v1_compose"):
        rows[r["label"], r["mode"]][r["dim"]] = r["x"]
    unit = lambda x: x / np.linalg.norm(x)
    for label in set(labels.tolist()):
        x = m[labels == label]
        mean = unit(x.mean(0))
        side = np.linalg.svd(x - x.mean(0) / len(x), full_matrices=False)[2][0]  # centred on the mean of the weighted rows
        heat = (x @ x.T).sum(1) - 1
        want = {"weighted_mean": mean, "principal": side * np.sign(side @ mean), "attentive": unit(np.exp(heat - heat.max()) @ x)}
        for mode, v in want.items():
            assert np.allclose([rows[label, mode][i] for i in range(64)], v, atol=1e-4), (label, mode)
        g = np.array([rows[label, "grassmann"][i] for i in range(64)])
        assert abs(np.linalg.norm(g) - 1) < 1e-4 and g @ mean > 0.9


def brute_v3_projection(spark, vectors):
    ids, labels, m = vectors
    want = {}
    for label in set(labels.tolist()):
        at = np.flatnonzero(labels == label)
        b = m[at[:8]]
        for i in at:
            x = np.linalg.lstsq(b.T, m[i], rcond=None)[0] @ b
            want[label, int(ids[i])] = {"retained": float(x @ x)}
    close(keyed(got(spark, "v3_projection"), "label", "vec_id"), want)


def brute_v5_decompose(spark, vectors):
    ids, labels, m = vectors
    axes = {str(k): m[labels == k].mean(0) for k in set(labels.tolist())}
    for r in got(spark, "v5_decompose"):
        v = m[np.flatnonzero(ids == r["vec_id"])[0]]
        c = {k: (a @ v / np.linalg.norm(a)) ** 2 for k, a in axes.items()}
        told = {k: float(x) for k, x in (p.split("=") for p in r["shares"].split(","))}
        assert told.keys() == c.keys() and all(abs(told[k] - c[k] / sum(c.values())) < 2e-4 for k in c)


def brute_v7_complement(spark, vectors):
    ids, labels, m = vectors
    rows = defaultdict(dict)
    for r in got(spark, "v7_complement"):
        rows[r["label"]][r["dim"]] = r["x"]
    for label in set(labels.tolist()):
        x = m[labels == label]
        rest = x[0] - np.linalg.lstsq(x[1:9].T, x[0], rcond=None)[0] @ x[1:9]
        assert np.allclose([rows[label][i] for i in range(64)], rest / np.linalg.norm(rest), atol=1e-5)


def brute_v9_alignment(spark, vectors):
    _, labels, m = vectors
    want = {}
    for a in set(labels.tolist()):
        for b in set(labels.tolist()):
            if a < b:
                u, v = (np.linalg.svd(m[labels == k] - m[labels == k].mean(0), full_matrices=False)[2][:5] for k in (a, b))
                want[a, b] = {"alignment": float(np.clip(np.linalg.svd(u @ v.T, compute_uv=False), 0, 1).mean())}
    close(keyed(got(spark, "v9_alignment"), "a", "b"), want, 2e-4)


def brute_v16_principal_components(spark, vectors):
    s = np.linalg.svd(vectors[2] - vectors[2].mean(0), compute_uv=False) ** 2
    close(keyed(got(spark, "v16_principal_components"), "component"), {(i,): {"explained": float(x)} for i, x in enumerate((s / s.sum())[:10])})


def brute_v19_clusters(spark, vectors):
    """Average linkage with all means computed anew at each merge."""
    ids, labels, m = vectors
    want = set()
    for label in set(labels.tolist()):
        at = np.flatnonzero(labels == label)
        s = m[at] @ m[at].T
        parts = [[i] for i in range(len(at))]
        while len(parts) > 1:
            best = max(((s[np.ix_(p, q)].mean(), -i, -j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j))
            if best[0] < 0.3:
                break
            i, j = -best[1], -best[2]
            parts[i] += parts.pop(j)
        want |= {(label, len(p), round(float(m[at[p]].var(0).mean()), 5)) for p in parts if len(p) >= 3}
    assert {(r["label"], r["n"], round(r["variance"], 5)) for r in got(spark, "v19_clusters")} == want


def brute_v20_voids(spark, vectors):
    p = np.random.RandomState(42).randn(50, 64)
    near = np.abs(vectors[2] @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T).max(0)
    close(keyed(got(spark, "v20_voids"), "probe"), {(i,): {"nearest": float(x)} for i, x in enumerate(near) if x < 0.36})


def brute_v21_geodesic(spark, vectors):
    import heapq

    ids, _, m = vectors
    s = m @ m.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1, kind="stable")[:, :5]
    best, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        far, u = heapq.heappop(heap)
        if far > best[u]:
            continue
        for v in near[u].tolist():
            x = far + math.acos(min(1.0, s[u, v]))
            if x < best.get(v, math.inf):
                best[v] = x
                heapq.heappush(heap, (x, v))
    close(keyed(got(spark, "v21_geodesic"), "vec_id"), {(int(ids[k]),): {"distance": x} for k, x in best.items()})


def brute_v22_metrics(spark, vectors):
    m = vectors[2]
    s = m @ m.T
    np.fill_diagonal(s, -2)
    r = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    r = r / r.sum()
    near = np.arccos(np.clip(np.sort(-s, axis=1)[:, :6] * -1, -1, 1))
    dim = np.median([(6 - 1) / np.log(x.max() / x).sum() for x in near])
    row = got(spark, "v22_metrics")[0]
    n = len(m)
    want = {"n": n, "mean_similarity": (s.sum() + 2 * n) / (n * (n - 1)), "isolation": (s.max(1) < 0.3).mean(), "dimension": dim, "coverage": -(r * np.log(r)).sum() / np.log(64)}
    close({0: row}, {0: {k: float(v) if k != "n" else v for k, v in want.items()}}, 1e-3)


def signs(m, bits=256):
    p = np.random.RandomState(42).randn(bits, m.shape[1])
    return (m @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T > 0).astype(np.uint8)


def brute_x23_sign_fingerprints(spark, vectors):
    want = {int(i): np.packbits(b).tobytes().hex().upper() for i, b in zip(vectors[0], signs(vectors[2]))}
    assert {r["vec_id"]: r["bits"] for r in got(spark, "x23_sign_fingerprints")} == want


def estimated(m):
    b = signs(m).astype(int)
    return np.cos(np.pi * (b[:, None] != b[None]).sum(2) / 256)


def brute_j9_lsh_pairs(spark, vectors):
    ids, _, m = vectors
    e = estimated(m)
    close(keyed(got(spark, "j9_lsh_pairs"), "a", "b"), {(int(ids[i]), int(ids[j])): {"similarity": float(e[i, j])} for i, j in zip(*np.nonzero(np.triu(e, 1) >= 0.4)) if e[i, j] >= 0.4})


def brute_j10_near_duplicates(spark, vectors):
    ids, labels, m = vectors
    e, name = estimated(m), [f"vec/{x}/{i}" for i, x in zip(ids, labels)]
    want = {tuple(sorted((name[i], name[j]))): {"similarity": float(e[i, j])} for i, j in zip(*np.nonzero(np.triu(e - 0.6 + 1e-9, 1) > 0)) if i < j}
    close(keyed(got(spark, "j10_near_duplicates"), "a", "b"), want)


def brute_c4_same_vectors(spark, vectors):
    ids, _, m = vectors
    kept = []
    for i in range(len(ids)):
        if not kept or (m[kept] @ m[i]).max() <= 0.4:
            kept.append(i)
    assert {r["vec_id"] for r in got(spark, "c4_same_vectors")} == {int(ids[i]) for i in kept}


def brute_k4_mmr(spark, vectors):
    ids, _, m = vectors
    rel = m @ m[0]
    pool, out = sorted(range(len(m)), key=lambda i: (-rel[i], i))[:500], []
    while len(out) < 10:
        out.append(max((i for i in pool if i not in out), key=lambda i: 0.7 * rel[i] - 0.3 * (max(m[out] @ m[i]) if out else 0)))
    assert [r["vec_id"] for r in sorted(got(spark, "k4_mmr"), key=lambda r: r["rank"])] == [int(ids[i]) for i in out]


def brute_k5_diverse_search(spark, vectors):
    ids, _, m = vectors
    rel = m @ m[0]
    pool = sorted(range(len(m)), key=lambda i: -rel[i])[:30]
    out = pool[:1]
    while len(out) < 10:
        out.append(max((i for i in pool if i not in out), key=lambda i: 0.7 * rel[i] - 0.3 * max(m[out] @ m[i])))
    assert [r["vec_id"] for r in sorted(got(spark, "k5_diverse_search"), key=lambda r: r["rank"])] == [int(ids[i]) for i in out]


@pytest.fixture(scope="module")
def readings(vectors):
    ids, labels, m = vectors
    value = [f"reading {i % 13} from group {x} by sensor {i % 5}" for i, x in zip(ids, labels)]
    return [f"vec/{i // 20}/{i}" for i in ids], value, [f"agent-{i // 7 % 3}" for i in ids], ids % 100 / 100, m


def brute_c6_compress_with_vectors(spark, readings):
    path, value, owner, conf, m = readings
    kept = []
    for i in range(len(path)):
        if not kept or (m[kept] @ m[i]).max() <= 0.3:
            kept.append(i)
    full = [max(1, (len(p) + len(o) + len(v) + 23) // 4) for p, o, v in zip(path, owner, value)]
    compact = [max(1, (len(p) + min(len(v), 100) + 4) // 4) for p, v in zip(path, value)]
    used, want = 0, {}
    for rank, i in enumerate(sorted(kept, key=lambda i: -(0.8 + 0.2 * conf[i]) / full[i] * 100)):
        form, t = ("full", full[i]) if used + full[i] <= 900 else ("compact", compact[i])
        if used + t <= 900:
            used += t
            want[path[i],] = {"rank": rank, "form": form, "tokens": t, "used": used, "n_removed": len(path) - len(kept)}
    close(keyed(got(spark, "c6_compress_with_vectors"), "path"), want)


def buckets(m, q):
    """Rows in the query's bucket of some table or in one that differs in one of its first three bits."""
    b, own, out = signs(m), signs(m[q : q + 1])[0], set()
    for t in range(4):
        key = own[64 * t : 64 * t + 64]
        for flip in (None, 0, 1, 2):
            k = key.copy()
            if flip is not None:
                k[flip] ^= 1
            out |= set(np.flatnonzero((b[:, 64 * t : 64 * t + 64] == k).all(1)).tolist())
    return {i: float(np.cos(np.pi * (b[i] != own).sum() / 256)) for i in out}


def brute_k10_probe(spark, readings):
    found = buckets(readings[4], 3)
    close(keyed(got(spark, "k10_probe"), "path"), {(readings[0][i],): {"similarity": s} for i, s in found.items() if s >= 0.2})


def brute_u2_probe_within(spark, readings):
    want = {readings[0][i] for i, s in buckets(readings[4], 3).items() if s >= -0.15 and readings[0][i].startswith("vec/0/")}
    assert {r["path"] for r in got(spark, "u2_probe_within")} == want


def bloom_bits(m):
    size = max(64, int(-1000 * math.log(0.01) / math.log(2) ** 2))
    k = max(1, int(size / 1000 * math.log(2)))
    return size, {int.from_bytes(hashlib.md5(b.tobytes() + struct.pack("I", i)).digest()[:4], "little") % size for b in signs(m) for i in range(k)}


def brute_x26_bloom(spark, vectors):
    assert {r["bit"] for r in got(spark, "x26_bloom")} == bloom_bits(vectors[2])[1]


def brute_a15_bloom_fill(spark, vectors):
    size, bits = bloom_bits(vectors[2])
    row = got(spark, "a15_bloom_fill")[0]
    assert row["n"] == len(vectors[2]) and abs(row["fill"] - len(bits) / size) < 1e-5


def hashed(text, dim):
    v = np.random.RandomState(int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")).randn(dim)
    return v / np.linalg.norm(v)


def brute_w9_re_embedded(spark, readings):
    path, value, _, _, m = readings
    v = [m[i] if i % 2 == 0 else hashed(value[i], 64) for i in range(len(path))]
    close(keyed(got(spark, "w9_re_embedded"), "path"), {(p,): {"first": float(x[0]), "last": float(x[63])} for p, x in zip(path, v)})


def brute_v15_embedded(spark, db):
    want = {}
    for path, text in db.execute(f"WITH {A.TURNS} SELECT path, value FROM turns").fetchall():
        v = hashed(text, 16) if text is not None else [None] * 16
        want[path,] = {f"v{i}": None if text is None else float(v[i]) for i in (0, 7, 15)}
    close(keyed(got(spark, "v15_embedded"), "path"), want)


def sign64(text):
    words = re.findall(r"\w+", text.lower())
    n = [sum(int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") >> b & 1 for w in words) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > max(1, len(words)))


def first_copies(rows):
    """Of (seq, text): the earliest row within three bits whose text is the same (hash vectors are alike for nothing else)."""
    f = {i: sign64(t) for i, t in rows}
    text = dict(rows)
    groups = defaultdict(list)
    for i in sorted(f):
        groups[text[i]].append(i)
    return {i: g[0] for g in groups.values() for i in g[1:]}


def brute_p2_near_copies(spark, db):
    rows = db.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()
    out = keyed(got(spark, "p2_near_copies"), "seq")
    assert {k[0]: v["copy_of"] for k, v in out.items()} == first_copies(rows) and out


def brute_p1_ingest(spark, db):
    rows = db.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    clean = {i: unicodedata.normalize("NFC", t).strip() if t is not None else None for i, t, *_ in rows}
    source = {i: s for i, *_, s in rows}
    copies = first_copies([(i, t) for i, t in clean.items() if t])
    want = {}
    raised = Counter(c for i, c in copies.items() if source[i] != source[c])
    for i, t, lang, s in rows:
        bad = "content" if not t or not t.strip() else "size" if len(t.encode()) > 262_144 else "duplicate" if i in copies and source[copies[i]] == s else None
        derived = f"doc/{copies[i]}" if i in copies and source[copies[i]] != s else None
        tags = ",".join(sorted({x.strip().lower() for x in (lang.upper(), lang, s)}))
        row = {"problem": bad, "derived_from": derived, "tags": tags, "confidence": None, "score": None}
        if bad is None:
            quality = min(1.0, len(re.split(r"\s+", clean[i].strip())) / 50)
            start = 0.7 * 0.6 + 0.3 * quality
            alpha = 1 + start + raised[i]
            row["confidence"] = alpha / (alpha + 2 - start)
            row["score"] = 0.45 * 0.5 + 0.25 * row["confidence"] + 0.2 * 0.6 + 0.1
        want[i,] = row
    close(keyed(got(spark, "p1_ingest"), "seq"), want)


BRUTE = {n.removeprefix("brute_"): f for n, f in list(globals().items()) if n.startswith("brute_")}


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_brute(name, spark, request):
    f = BRUTE[name]
    names = f.__code__.co_varnames[1 : f.__code__.co_argcount]
    f(spark, *[request.getfixturevalue(n) for n in names])


def test_every_query_is_checked():
    """A query has SQL or a test by brute force."""
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | set(BRUTE)
