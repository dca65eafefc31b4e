"""Reads by meaning, vectors beside entries, compressed reads, events, and what the written protocol adds to a search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import columns as C
from marlstone.operators import compression, evaluation, protocol, provenance, providers, reasoning, similarity, store, vectorstore
from marlstone.plans import retrieval
from marlstone.plans.reasoning_queries import CONTRADICTIONS, SPANS
from marlstone.plans.registry import query
from marlstone.sources import adapters as A
from marlstone.streaming import events

READ = (
    A.VECTOR_WRITES
    + """, now AS (SELECT max(updated_at) AS t FROM cur), q AS (SELECT v AS qv FROM cur WHERE seq = 3),
refs AS (SELECT path, count(*) AS n FROM (SELECT unnest(refs) AS path FROM cur) GROUP BY path),
found AS (SELECT * FROM cur WHERE {where} ORDER BY updated_at DESC, path LIMIT 500),
sig AS (SELECT f.*, pow(2.0, -greatest(t - updated_at, 0) / 3600) AS recency, confidence AS conf, greatest(0.0, list_dot_product(v, qv)) AS sim,
  CASE WHEN coalesce(n, 0) > 0 THEN least(1.0, 0.3 + 0.3 * ln(1.0 + n)) ELSE 0.1 END AS ref FROM found f CROSS JOIN now CROSS JOIN q LEFT JOIN refs USING (path)),
live AS (SELECT CASE WHEN var_pop(recency) > 0.001 THEN 0.20 ELSE 0 END AS a, CASE WHEN var_pop(conf) > 0.001 THEN 0.20 ELSE 0 END AS b,
  CASE WHEN var_pop(sim) > 0.001 THEN 0.40 ELSE 0 END AS c, CASE WHEN var_pop(ref) > 0.001 THEN 0.20 ELSE 0 END AS d FROM sig),
scored AS (SELECT sig.*, round(recency*a/(a+b+c+d) + conf*b/(a+b+c+d) + sim*c/(a+b+c+d) + ref*d/(a+b+c+d), 9) AS score, row_number() OVER (ORDER BY updated_at DESC, path) AS i,
  greatest(1, (length(path)+length(owner)+length(value)+23)//4) AS t_full, greatest(1, (length(path)+least(length(value),100)+4)//4) AS t_compact, greatest(1, length(path)//4) AS t_path FROM sig, live),
k AS (SELECT least(count(*), greatest(10, 2 * ({budget} // greatest(1, sum(t_full)//count(*))))) AS k FROM scored)"""
)
TOP = ", best AS (SELECT row_number() OVER (ORDER BY score DESC, path) - 1 AS rank, * FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, path) <= (SELECT k FROM k))"
MMR = """, pick AS (SELECT 0::BIGINT AS step, i, score, v, 0.0::DOUBLE AS worst, false AS done FROM scored UNION ALL
  SELECT step + 1, i, score, v, CASE WHEN step = 0 THEN list_dot_product(v, pv) ELSE greatest(worst, list_dot_product(v, pv)) END, i = pi FROM
  (SELECT *, first_value(v) OVER w AS pv, first_value(i) OVER w AS pi FROM pick WHERE NOT done WINDOW w AS (ORDER BY 0.7 * score - 0.3 * worst DESC, i)) WHERE step < (SELECT k FROM k)),
best AS (SELECT step - 1 AS rank, s.* FROM pick p JOIN scored s USING (i) WHERE done)"""
NEAR = """, top AS (SELECT path FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, path) <= (SELECT k FROM k)),
wide AS (SELECT path FROM top UNION SELECT regexp_extract(path, '^(.*/)', 1) || (CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) - 1) FROM top UNION SELECT regexp_extract(path, '^(.*/)', 1) || (CAST(regexp_extract(path, '([0-9]+)$', 1) AS BIGINT) + 1) FROM top),
best AS (SELECT row_number() OVER (ORDER BY path) - 1 AS rank, s.* FROM scored s WHERE path IN (SELECT path FROM wide))"""
RERANK = """, best AS (SELECT row_number() OVER (ORDER BY told DESC, i) - 1 AS rank, * FROM (SELECT *, len(list_intersect(list_distinct(string_split(lower(value), ' ')), ['reading', '7', 'from', 'group', '3', 'by', 'sensor', '2'])) / 8.0 AS told FROM scored)
  QUALIFY row_number() OVER (ORDER BY told DESC, i) <= (SELECT k FROM k))"""
PACK = """, pack AS (SELECT -1::BIGINT AS rank, 0::BIGINT AS used, 'none' AS form, 0::BIGINT AS tokens UNION ALL
  SELECT b.rank, p.used + CASE WHEN p.used + t_full <= {budget} THEN t_full WHEN p.used + t_compact <= {budget} THEN t_compact ELSE t_path END,
  CASE WHEN p.used + t_full <= {budget} THEN 'full' WHEN p.used + t_compact <= {budget} THEN 'compact' ELSE 'path' END,
  CASE WHEN p.used + t_full <= {budget} THEN t_full WHEN p.used + t_compact <= {budget} THEN t_compact ELSE t_path END
  FROM pack p JOIN best b ON b.rank = p.rank + 1 WHERE p.used + t_full <= {budget} OR p.used + t_compact <= {budget} OR p.used + t_path <= {budget})
SELECT b.rank, b.path, round(b.score, 6) AS score, round(b.sim, 6) AS sim, p.form, p.tokens, p.used, (SELECT count(*) FROM scored) AS total_matched FROM pack p JOIN best b USING (rank)"""


def _read_sql(choice: str, budget: int, where: str = "true") -> str:
    return f"WITH RECURSIVE {(READ + choice + PACK).format(budget=budget, where=where)}"


def _asked(spark, d) -> list[float]:
    return list(A.vector_writes(spark, d).where(F.col("seq") == 3).first().v)  # one vector


def _got(spark, d, **wanted):
    out = retrieval.get(store.latest(A.vector_writes(spark, d)), query=_asked(spark, d), **wanted)
    return out.select(F.col("rank").cast("long").alias("rank"), "path", F.round("score", 6).alias("score"), F.round("sim", 6).alias("sim"), "form", "tokens", "used", "total_matched")


@query(_read_sql(TOP, 9000))
def m1_get_similar(spark, d):
    """A budget that holds all candidates: the best first, none left to diversity."""
    return _got(spark, d, budget=9000)


@query(_read_sql(MMR, 300))
def m2_get_mmr(spark, d):
    """Several owners and more candidates than fit: chosen for relevance and difference."""
    return _got(spark, d, budget=300)


@query(_read_sql(NEAR, 260, "owner = 'agent-1'"))
def m3_get_neighbours(spark, d):
    """One owner: numbered neighbours come along, in order of path."""
    return _got(spark, d, budget=260, owner="agent-1")


@query(_read_sql(RERANK, 300))
def m4_get_reranked(spark, d):
    """A reranker decides over all candidates."""
    return _got(spark, d, budget=300, text="reading 7 from group 3 by sensor 2", rerank=providers.word_overlap)


@query(f"WITH {A.VECTORS} SELECT path, position, round(v[1], 6) AS first FROM vec JOIN (VALUES ('vec/0/none', 0), ((SELECT path FROM vec WHERE vec_id = 7), 1), ((SELECT path FROM vec WHERE vec_id = 2), 2)) t(path, position) USING (path)")
def s10_vector_subset(spark, d):
    v = A.vectors(spark, d)
    at = {r.vec_id: r.path for r in v.where(F.col("vec_id").isin(2, 7)).select("vec_id", "path").collect()}  # two rows
    return vectorstore.subset(v, ["vec/0/none", at[7], at[2]]).select("path", "position", F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {A.VECTORS} SELECT path, provider, round(CASE WHEN vec_id % 2 = 0 THEN v[2] ELSE v[1] END, 6) AS first FROM vec, (VALUES ('a'), ('b')) p(provider) WHERE provider = 'a' OR vec_id % 2 = 0")
def w2_vector_upsert(spark, d):
    """A second write takes the first one's place; a vector of another dimension is refused."""
    v, x = A.vectors(spark, d), F.col("v")
    turned = F.concat(F.slice(x, 2, 63), F.slice(x, 1, 1))
    log = v.select("path", F.lit("a").alias("provider"), x, F.lit(1).alias("seq")).union(v.where("vec_id % 2 = 0").select("path", F.explode(F.array(F.lit("a"), F.lit("b"))), turned, F.lit(2)))
    log = log.union(v.select("path", F.lit("a"), F.slice(x, 1, 16), F.lit(3)))
    return store.latest_vectors(log, 64).select("path", "provider", F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {A.VECTORS} SELECT path FROM vec WHERE label <> 3")
def w4_vectors_deleted(spark, d):
    v = A.vectors(spark, d)
    return vectorstore.without_vectors(v, v.where("label = 3")).select("path")


@query(f"WITH {A.VECTOR_WRITES} SELECT path, CASE WHEN seq % 3 <> 0 THEN len(v) END AS dim, CASE WHEN seq % 3 <> 0 THEN round(v[1], 6) END AS first FROM cur")
def j1_entries_with_vectors(spark, d):
    rows = store.latest(A.vector_writes(spark, d))
    out = vectorstore.with_vectors(rows.drop("v"), rows.where(F.col("seq") % 3 != 0))
    return out.select("path", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("dim"), F.round(F.col("v")[0], 6).alias("first"))


HITS = A.VECTOR_WRITES + ", hits AS (SELECT path, value, list_dot_product(v, (SELECT v FROM cur WHERE seq = 3)) AS s FROM cur ORDER BY s DESC, path LIMIT 30)"


@query(f"WITH {HITS} SELECT path, value, round(s, 6) AS similarity FROM hits WHERE path NOT LIKE 'vec/1/%'")
def j2_hits_with_entries(spark, d):
    """Vector hits whose entry is still there."""
    rows = store.latest(A.vector_writes(spark, d))
    hits = similarity.topk(rows.select("path", "v"), _asked(spark, d), 30)
    return vectorstore.entries_of(hits, rows.where(~F.col("path").startswith("vec/1/"))).select("path", "value", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {HITS} SELECT path, round(s, 6) AS similarity FROM hits WHERE regexp_full_match(path, 'vec/[^/]*/[^/]*') AND (path LIKE 'vec/2/%' OR path LIKE 'vec/4/%' OR path LIKE 'vec/0/%')")
def f9_readable_neighbours(spark, d):
    rows = store.latest(A.vector_writes(spark, d))
    hits = similarity.topk(rows.select("path", "v"), _asked(spark, d), 30)
    return vectorstore.entries_of(hits, rows, ["vec/2/**", "vec/4/*", "vec/0/*"]).select("path", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {A.VECTOR_WRITES} SELECT 'vec/' || (seq // 20) AS prefix, count(DISTINCT owner) AS owners, count(DISTINCT owner) > 1 AS diverse FROM cur GROUP BY 1")
def a4_distinct_owners(spark, d):
    g = A.vector_writes(spark, d).groupBy(C.prefix(F.col("path")).alias("prefix")).agg(F.count_distinct("owner").alias("owners"))
    return g.withColumn("diverse", F.col("owners") > 1)


NEWEST = A.CURRENT + """, seen AS (SELECT path, count(*) AS version, substr(md5(arg_max(value, seq)), 1, 16) AS value_hash FROM writes WHERE updated_at <= 1705276800 GROUP BY path),
e AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, path) AS position FROM cur QUALIFY row_number() OVER (ORDER BY updated_at DESC, path) <= 400),
dl AS (SELECT e.*, CASE WHEN s.version IS NULL AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.value_hash = substr(md5(e.value), 1, 16)) THEN 0 WHEN s.version IS NOT NULL AND e.version > s.version THEN 1 ELSE 2 END AS class FROM e LEFT JOIN seen s USING (path)),
dd AS (SELECT *, row_number() OVER (PARTITION BY md5(value) ORDER BY class, position) AS nth FROM dl),
r AS (SELECT *, row_number() OVER (ORDER BY class, position) AS rank, greatest(1, (length(path)+length(owner)+length(value)+23)//4) AS t_full, greatest(1, (length(path)+least(length(value),100)+4)//4) AS t_compact FROM dd WHERE nth = 1),
pk AS (SELECT 0::BIGINT AS rank, 0::BIGINT AS used, 'none' AS form, 0::BIGINT AS tokens UNION ALL SELECT r.rank,
 used + CASE WHEN used + t_full <= 600 THEN t_full WHEN used + t_compact <= 600 THEN t_compact ELSE 0 END, CASE WHEN used + t_full <= 600 THEN 'full' WHEN used + t_compact <= 600 THEN 'compact' ELSE 'none' END,
 CASE WHEN used + t_full <= 600 THEN t_full WHEN used + t_compact <= 600 THEN t_compact ELSE 0 END FROM pk JOIN r ON r.rank = pk.rank + 1)"""


def _compressed(spark, d):
    w = A.writes(spark, d)
    newest = retrieval.candidates(store.latest(w), cap=400)
    listed = newest.withColumn("position", F.row_number().over(W.orderBy(F.desc("updated_at"), "path")))  # 400 rows
    seen = store.as_of(w, 1705276800.0).select("path", "version", C.value_hash(F.col("value")).alias("value_hash"))
    return compression.compress(listed, seen, 600)


@query(f"WITH RECURSIVE {NEWEST} SELECT r.path, CASE class WHEN 0 THEN 'new' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS delta, pk.form, pk.tokens, pk.used FROM pk JOIN r USING (rank) WHERE pk.form <> 'none'")
def c6_compress(spark, d):
    """Delta, repeats, packing that passes over what does not fit."""
    return _compressed(spark, d).select("path", "delta", "form", "tokens", "used")


@query(f"WITH RECURSIVE {NEWEST} SELECT (SELECT count(*) FROM e) AS original, (SELECT count(*) FROM pk WHERE form <> 'none') AS compressed, (SELECT count(*) FROM dd WHERE nth > 1) AS duplicates, (SELECT count(*) FROM dl WHERE class = 2) AS unchanged, CAST((SELECT sum(t_full) FROM r) - (SELECT max(used) FROM pk) AS BIGINT) AS saved, round((SELECT max(used) FROM pk) / greatest(1, (SELECT sum(t_full) FROM r)), 4) AS ratio")
def c6_compression_stats(spark, d):
    return compression.compression_stats(_compressed(spark, d))


@query(f"WITH {NEWEST} SELECT path, class, row_number() OVER (ORDER BY class, position) AS nth FROM dl".replace("WITH ", "WITH RECURSIVE ", 1))
def u3_by_class(spark, d):
    w = A.writes(spark, d)
    listed = retrieval.candidates(store.latest(w), cap=400).withColumn("position", F.row_number().over(W.orderBy(F.desc("updated_at"), "path")))  # 400 rows
    seen = store.as_of(w, 1705276800.0).select("path", "version", C.value_hash(F.col("value")).alias("value_hash"))
    return compression.by_class(compression.delta(listed, seen)).select("path", F.col("class").cast("long").alias("class"), F.row_number().over(W.orderBy("class", "position")).cast("long").alias("nth"))


@query(f"WITH {A.VECTOR_WRITES}, ctx AS (SELECT * FROM cur WHERE seq % 50 = 0) SELECT path, round((0.5 * CASE WHEN value IN (SELECT value FROM ctx) THEN 0.0 ELSE 1.0 END + 0.3 * greatest(0.0, 1 - (SELECT max(list_dot_product(c.v, x.v)) FROM ctx x)) + 0.2 * confidence) / greatest(1, (length(path)+length(owner)+length(value)+23)//4) * 100, 5) AS density FROM cur c")
def k7_density_ranking(spark, d):
    """Densest first, with vectors: what is unlike the context in words and in meaning."""
    rows = store.latest(A.vector_writes(spark, d))
    return compression.density(rows, rows.where(F.col("seq") % 50 == 0)).orderBy(F.desc("density"), "path").select("path", F.round("density", 5).alias("density"))


@query()
def c6_compress_with_vectors(spark, d):
    rows = store.latest(A.vector_writes(spark, d)).withColumn("position", F.col("seq"))
    return compression.compress(rows, None, 900, threshold=0.3).select("path", F.col("rank").cast("long").alias("rank"), "form", "tokens", "used", "n_removed")


@query(f"""WITH {CONTRADICTIONS}, {SPANS.format('writes').removeprefix(A.WRITES + ', v AS (SELECT *, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS seq_end FROM writes), ')},
lat AS (SELECT path, max(seq) AS seq, arg_max(updated_at, seq) AS updated_at FROM writes GROUP BY path)
SELECT 'conflict' AS type, path, seq, old_path AS other FROM con UNION ALL
SELECT 'gap', plan_path, seq, ref FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = w.ref AND v.type = 'observation' AND v.seq < w.seq AND (v.seq_end IS NULL OR v.seq_end > w.seq)) UNION ALL
SELECT 'stale', path, seq, NULL FROM lat WHERE (SELECT max(updated_at) FROM lat) - updated_at > 3600 UNION ALL
SELECT 'summary', path, seq, prefix FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS prefix, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY seq) AS nth FROM writes) WHERE nth % 10 = 0""")
def e5_reasoning_events(spark, d):
    return reasoning.events(A.writes(spark, d))


@query(f"WITH {A.WRITES} SELECT path, source_owner, dropped FROM (SELECT path, owner AS source_owner, (SELECT greatest(count(*) - 300, 0) FROM writes) AS dropped, row_number() OVER (ORDER BY updated_at DESC, path DESC) AS n FROM writes) WHERE n <= 300")
def e7_history_ring(spark, d):
    return events.history(events.change_events(A.writes(spark, d)), 300).select("path", "source_owner", "dropped")


@query(f"WITH {A.WRITES} SELECT type, path, owner AS source_owner, updated_at AS ts FROM (SELECT 'change' AS type, path, owner, updated_at FROM writes UNION ALL SELECT 'delete', path, NULL, updated_at FROM writes WHERE ttl = 'turn') WHERE type = 'delete'")
def e14_subscription_by_type(spark, d):
    w = A.writes(spark, d)
    both = events.change_events(w).union(events.delete_events(w.where("ttl = 'turn'").select("path", F.col("updated_at").alias("ts"))))
    return events.of_types(both, "delete").select("type", "path", "source_owner", "ts")


MIXED = """w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM w), h AS (SELECT doc_id, len(ws) AS l, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM w, (VALUES ('the'), ('ander'), ('data')) t(term)),
df AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY term),
b AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS bm25 FROM h JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""


@query(f"WITH {MIXED} SELECT d.doc_id, round(0.7 * (d.doc_id % 10) / 10.0 + 0.3 * coalesce(bm25 / (SELECT max(bm25) FROM b), 0), 6) AS hybrid FROM documents d LEFT JOIN b USING (doc_id) WHERE text IS NOT NULL")
def x31_hybrid(spark, d):
    docs = A.table(spark, d, "documents").where(F.col("text").isNotNull())
    scored = docs.select("doc_id", (F.col("doc_id") % 10 / 10).alias("semantic")).join(protocol.bm25(docs, ["the", "ander", "data"]), "doc_id", "left")
    return protocol.hybrid(scored, "semantic", "bm25").select("doc_id", F.round("hybrid", 6).alias("hybrid"))


@query(f"WITH {A.CURRENT} SELECT path, round(greatest(0, least(1, confidence * (1 + CASE WHEN type = 'fact' THEN 0.5 ELSE 0 END) * (1 + CASE WHEN updated_at > 1706000000 THEN 0.1 ELSE 0 END) * (1 - CASE WHEN owner = 'agent-2' THEN 0.3 ELSE 0 END))), 6) AS score FROM cur")
def x28_boosted(spark, d):
    s = protocol.boosted(F.col("confidence"), F.when(F.col("type") == "fact", 0.5).otherwise(0.0), F.when(F.col("owner") == "agent-2", 0.3).otherwise(0.0), F.when(F.col("updated_at") > 1706000000, 0.1).otherwise(0.0))
    return store.latest(A.writes(spark, d)).select("path", F.round(s, 6).alias("score"))


@query(f"WITH {A.CURRENT} SELECT path, round(0.5 * 0.6 / 0.9, 6) AS relevance, round(confidence * 0.3 / 0.9, 6) AS confidence, round(greatest(0, least(1, 0.5 * 0.6 / 0.9 + confidence * 0.3 / 0.9)), 6) AS composite FROM cur")
def x28_explained(spark, d):
    e = protocol.explained({"relevance": F.lit(0.5), "confidence": F.col("confidence")}, {"relevance": 0.6, "confidence": 0.3})
    return store.latest(A.writes(spark, d)).select("path", e.alias("e")).select("path", F.round("e.relevance.weighted", 6).alias("relevance"), F.round("e.confidence.weighted", 6).alias("confidence"), F.round("e.composite_score", 6).alias("composite"))


@query("SELECT o_custkey, round(greatest(0.05, least(0.99, max(o_totalprice / 500000))), 6) AS trust FROM orders GROUP BY o_custkey")
def a21_max_trust(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 500000).alias("trust"))
    return protocol.merged_trust(o, "o_custkey").withColumn("trust", F.round("trust", 6))


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 200 > 90 THEN r + 0.1 * (1500 - r) ELSE r END, 6) AS rating FROM (SELECT c_custkey, 1500 + c_acctbal / 10 AS r FROM customer)")
def n10_regressed(spark, d):
    c = A.table(spark, d, "customer")
    return c.select("c_custkey", F.round(protocol.regressed(1500 + F.col("c_acctbal") / 10, F.col("c_custkey") % 200), 6).alias("rating"))


@query(f"WITH {A.CURRENT} SELECT path, updated_at FROM cur WHERE updated_at BETWEEN 1705000000 AND 1706000000")
def j16_event_range(spark, d):
    return protocol.in_event_range(store.latest(A.writes(spark, d)), 1705000000.0, 1706000000.0).select("path", "updated_at")


@query(f"WITH {A.CURRENT} SELECT path, round(exp(-abs(updated_at - 1705500000) / 86400), 6) AS proximity, row_number() OVER (ORDER BY abs(updated_at - 1705500000), path) AS nth FROM cur")
def j16_proximity(spark, d):
    near = protocol.by_proximity(store.latest(A.writes(spark, d)), 1705500000.0, 86400.0)
    return near.select("path", F.round("proximity", 6).alias("proximity"), F.row_number().over(W.orderBy(F.abs(F.col("updated_at") - 1705500000), "path")).cast("long").alias("nth"))


@query(f"""WITH {A.WRITES}, n AS (SELECT seq, path, substr(md5(value), 1, 16) AS h, row_number() OVER (PARTITION BY path ORDER BY seq) AS version FROM writes WHERE seq % 5 <> 0),
ev AS (SELECT seq, CASE seq % 10 WHEN 0 THEN 'confirm' ELSE 'contradict' END AS kind, path, substr(md5(value), 1, 16) AS own FROM writes WHERE seq % 5 = 0),
m AS (SELECT ev.*, (SELECT max(n.seq) FROM n WHERE n.path = ev.path AND n.seq < ev.seq) AS parent FROM ev)
SELECT m.seq, CASE kind WHEN 'confirm' THEN 'confirmed' ELSE 'contradicted' END AS derivation, CASE kind WHEN 'confirm' THEN n.h ELSE own END AS value_hash, n.version + CASE kind WHEN 'confirm' THEN 0 ELSE 1 END AS version, m.parent FROM m JOIN n ON n.seq = m.parent""")
def g2_recorded(spark, d):
    w = A.writes(spark, d)
    ev = w.where("seq % 5 = 0").select("seq", F.when(F.col("seq") % 10 == 0, "confirm").otherwise("contradict").alias("kind"), "path", "owner", C.value_hash(F.col("value")).alias("value_hash"), F.array().cast("array<string>").alias("sources"))
    out = provenance.recorded(provenance.nodes(w.where("seq % 5 <> 0")), ev).where(F.col("derivation").isin("confirmed", "contradicted"))
    return out.select("seq", "derivation", "value_hash", F.col("version").cast("long").alias("version"), F.col("parents")[0].alias("parent"))


@query(f"WITH RECURSIVE {A.EDGES}, c AS (SELECT parent AS a, child AS b, 1.0 + length(child) % 3 AS w FROM edges), r(node, cost) AS (SELECT 'region/1', 0.0::DOUBLE UNION SELECT c.b, cost + w FROM r JOIN c ON c.a = node) SELECT node, min(cost) AS cost FROM r GROUP BY node")
def g8_shortest(spark, d):
    e = A.edges(spark, d).select(F.col("parent").alias("actor"), F.col("child").alias("target"), (1.0 + F.length("child") % 3).alias("cost"))
    return provenance.shortest(e, "region/1")


@query(f"""WITH {A.VECTOR_WRITES}, q AS (SELECT v AS qv FROM cur WHERE seq = 3), n AS (SELECT *, list_dot_product(v, qv) AS s FROM cur, q WHERE type = 'fact' ORDER BY s DESC, path LIMIT 45)
SELECT path, round(greatest(0, least(1, 0.45 * greatest(0.0, s) + 0.25 * confidence + 0.20 * 0.5 + 0.10 * exp(-abs(1704067200 - updated_at) / 86400))), 6) AS score FROM n ORDER BY greatest(0, least(1, 0.45 * greatest(0.0, s) + 0.25 * confidence + 0.20 * 0.5 + 0.10 * exp(-abs(1704067200 - updated_at) / 86400))) DESC, path LIMIT 10 OFFSET 5""")
def p4_search(spark, d):
    rows = store.latest(A.vector_writes(spark, d)).withColumn("trust", F.lit(0.5))
    return protocol.search(rows, _asked(spark, d), 10, 5, F.col("type") == "fact", 3, 1704067200.0).select("path", F.round("score", 6).alias("score"))


RANKED = A.VECTOR_WRITES + ", rk AS (SELECT path, length(value) // 4 AS tokens, row_number() OVER (ORDER BY list_dot_product(v, (SELECT v FROM cur WHERE seq = 3)) DESC, path) AS rank FROM cur), us AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS u FROM rk WHERE rank <= 10)"


def _ranked(spark, d):
    hits = similarity.topk(store.latest(A.vector_writes(spark, d)), _asked(spark, d), 10)
    return hits.select("path", F.floor(F.length("value") / 4).alias("tokens"), F.row_number().over(W.orderBy(F.desc("similarity"), "path")).alias("rank"))  # ten rows


@query(f"WITH {RANKED} SELECT path, rank, tokens AS taken FROM us WHERE u <= 70")
def bx3_vector_read(spark, d):
    """The nearest ten, as far as a budget goes: the read of a vector store, and of naive retrieval over chunks."""
    return evaluation.ranked_within(_ranked(spark, d), 70).select("path", F.col("rank").cast("long").alias("rank"), "taken")


@query(f"WITH {RANKED} SELECT path, rank, CASE WHEN u <= 76 THEN tokens ELSE 76 - (u - tokens) END AS taken FROM us WHERE u <= 76 OR (u - tokens <= 76 AND 76 - (u - tokens) > 1)")
def n5_last_cut(spark, d):
    """The same with the last chunk cut to what is left."""
    return evaluation.ranked_within(_ranked(spark, d), 76, cut=True, least=1).select("path", F.col("rank").cast("long").alias("rank"), "taken")


@query("""WITH r AS (SELECT o_orderkey AS run, o_custkey AS total, o_custkey % 50 AS redundant, o_custkey % 70 AS useful, o_orderkey % 5 AS det, o_orderkey % 3 AS mis, (o_orderkey % 7) / 7.0 AS p, (o_orderkey % 11) / 11.0 AS q FROM orders)
SELECT run, round(CASE WHEN total = 0 THEN 0 ELSE redundant / total END, 6) AS waste, round(CASE WHEN total = 0 THEN 0 ELSE useful / total END, 6) AS efficiency, round(CASE WHEN det + mis = 0 THEN 0 ELSE det / (det + mis) END, 6) AS rate, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r""")
def bx7_rates(spark, d):
    o = A.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = o.select(k.alias("run"), c.alias("total_tokens_read"), (c % 50).alias("redundant_tokens"), (c % 70).alias("useful_tokens"), (k % 5).alias("contradictions_detected"), (k % 3).alias("contradictions_missed"), (k % 7 / 7).alias("context_precision"), (k % 11 / 11).alias("context_recall"))
    return evaluation.rates(r).select("run", *[F.round(a, 6).alias(b) for a, b in (("token_waste_ratio", "waste"), ("token_efficiency", "efficiency"), ("contradiction_detection_rate", "rate"), ("f1_score", "f1"))])


@query()
def k10_probe(spark, d):
    rows = store.latest(A.vector_writes(spark, d))
    return vectorstore.probe(rows, _asked(spark, d), 0.2).select("path", F.round("similarity", 6).alias("similarity"))


@query()
def u2_probe_within(spark, d):
    rows = store.latest(A.vector_writes(spark, d))
    return vectorstore.probe_within(rows, _asked(spark, d), "vec/0", least=10).select("path")


@query()
def x26_bloom(spark, d):
    return vectorstore.Bloom(1000).set_bits(similarity.sign_bits(A.vectors(spark, d)))


@query()
def a15_bloom_fill(spark, d):
    return vectorstore.Bloom(1000).fill_ratio(similarity.sign_bits(A.vectors(spark, d))).select("n", F.round("fill", 6).alias("fill"))


@query(f"WITH {A.VECTORS} SELECT vec_id, t, t = 1 AS seen FROM vec, (VALUES (0), (1)) x(t) WHERE t = 0 OR vec_id % 4 = 0")
def v14_seen_before(spark, d):
    """Every fourth vector is written twice; the second time it is known."""
    v = A.vectors(spark, d).select("vec_id", "v")
    log = v.select("vec_id", "v", F.lit(0).alias("t")).union(v.where("vec_id % 4 = 0").select("vec_id", "v", F.lit(1)))
    out = vectorstore.seen_before(log.withColumn("seq", F.col("t") * 1_000_000 + F.col("vec_id")))
    return out.select("vec_id", F.col("t").cast("long").alias("t"), "seen")


@query()
def w9_re_embedded(spark, d):
    rows = store.latest(A.vector_writes(spark, d))
    stored = rows.where(F.col("seq") % 2 == 0).select("path", "v").union(rows.where("seq < 4").select(F.concat(F.lit("gone/"), "path"), "v"))
    out = providers.re_embedded(rows.drop("v"), stored, providers.HashProvider(64))
    return out.select("path", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query()
def v15_embedded(spark, d):
    return providers.embed(A.turns(spark, d), providers.HashProvider(16)).select("path", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in (0, 7, 15)])


@query()
def p2_near_copies(spark, d):
    t = A.table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("seq"), "source", F.col("text").alias("content"))
    return protocol.near_copies(providers.embed(t, providers.HashProvider(32), "content")).select("seq", "copy_of", F.col("distance").cast("long").alias("distance"), F.round("similarity", 6).alias("similarity"))


@query()
def p1_ingest(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.array(F.upper("lang"), F.col("lang"), F.col("source")).alias("tags"), "source", F.lit(0.6).alias("source_trust"))
    known = [r.source for r in docs.select("source").distinct().orderBy("source").limit(100).collect()]
    out = protocol.ingest(docs, known, lambda rows, text: providers.embed(rows, providers.HashProvider(32), text))
    return out.select("seq", "problem", "derived_from", F.array_join("tags", ",").alias("tags"), F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))
