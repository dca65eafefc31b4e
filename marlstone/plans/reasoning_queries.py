"""Contradictions, gaps, staleness, summaries, confidence, trust and provenance over the write log."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import compression, confidence, provenance, reasoning, store, trust
from marlstone.plans.registry import query
from marlstone.sources import adapters as A

NORM = "lower(trim({}))"


CONTRADICTIONS = A.WRITES + f""", v AS (SELECT *, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS seq_end, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS pre FROM writes),
con AS (SELECT n.seq, o.seq AS old_seq, n.path, o.path AS old_path FROM v n JOIN v o ON o.pre = n.pre AND o.type = n.type AND o.seq < n.seq AND o.owner <> n.owner AND o.path <> n.path
 AND {NORM.format('n.value')} <> {NORM.format('o.value')} AND (o.seq_end IS NULL OR o.seq_end > n.seq))"""


@query(f"WITH {CONTRADICTIONS} SELECT *, 0.5::DOUBLE AS similarity FROM con")
def j3_contradictions(spark, d):
    return reasoning.contradictions(A.writes(spark, d)).select("seq", "old_seq", "path", "old_path", "similarity")


@query(f"""WITH {A.VECTOR_WRITES}, v AS (SELECT *, 'vec/' || (seq // 20) AS pre FROM cur)
SELECT n.seq, o.seq AS old_seq, round(list_dot_product(n.v, o.v), 5) AS similarity FROM v n JOIN v o ON o.pre = n.pre AND o.seq < n.seq AND o.owner <> n.owner WHERE list_dot_product(n.v, o.v) >= 0.05 AND {NORM.format('n.value')} <> {NORM.format('o.value')}""")
def j3_vector(spark, d):
    return reasoning.contradictions(A.vector_writes(spark, d), threshold=0.05).select("seq", "old_seq", F.round("similarity", 5).alias("similarity"))


SPANS = A.WRITES + ", v AS (SELECT *, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS seq_end FROM writes), wanted AS (SELECT seq, path AS plan_path, owner, unnest(refs) AS ref FROM {} WHERE type = 'plan')"


@query(f"WITH {SPANS.format('writes')} SELECT seq, plan_path, owner, ref FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.path = w.ref AND v.type = 'observation' AND v.seq < w.seq AND (v.seq_end IS NULL OR v.seq_end > w.seq))")
def j4_gaps_at_write(spark, d):
    return reasoning.gaps(A.writes(spark, d)).select("seq", "plan_path", "owner", "ref")


@query(f"WITH {A.CURRENT}, wanted AS (SELECT seq, path AS plan_path, owner, unnest(refs) AS ref FROM cur WHERE type = 'plan') SELECT seq, plan_path, owner, ref FROM wanted WHERE ref NOT IN (SELECT path FROM cur WHERE type = 'observation')")
def j4_gaps_now(spark, d):
    return reasoning.gaps(A.writes(spark, d), at_write=False).select("seq", "plan_path", "owner", "ref")


@query(f"WITH {A.WRITES}, l AS (SELECT *, lag(owner) OVER (PARTITION BY path ORDER BY seq) AS o, lag(value) OVER (PARTITION BY path ORDER BY seq) AS pv, lag(confidence) OVER (PARTITION BY path ORDER BY seq) AS pc FROM writes) SELECT seq, path, split_part(path, '/', 2) AS domain, CASE WHEN {NORM.format('value')} = {NORM.format('pv')} THEN 'confirmation' ELSE 'contradiction' END AS kind, owner AS actor, o AS target, confidence AS conf_actor, pc AS conf_target FROM l WHERE o IS NOT NULL AND o <> owner")
def j7_cross_agent(spark, d):
    return reasoning.cross_agent(A.writes(spark, d)).drop("ts")


@query(f"WITH {A.CURRENT}, now AS (SELECT max(updated_at) AS t FROM cur) SELECT path, round(t - updated_at, 3) AS age FROM cur, now WHERE t - updated_at > 3600")
def f10_stale(spark, d):
    rows = store.latest(A.writes(spark, d))
    now = rows.agg(F.max("updated_at").alias("t"))
    return reasoning.stale(rows.crossJoin(F.broadcast(now)), F.col("t")).select("path", F.round("age", 3).alias("age"))  # one row


@query(f"""WITH {A.CURRENT}, p AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS prefix FROM cur)
SELECT prefix, count(*) AS n, count(DISTINCT owner) AS owners, count(*) FILTER (WHERE type = 'fact') AS n_fact, count(*) FILTER (WHERE type = 'decision') AS n_decision,
 count(*) FILTER (WHERE type = 'plan') AS n_plan, count(*) FILTER (WHERE type = 'observation') AS n_observation,
 first(path ORDER BY updated_at DESC, path DESC) AS latest_path, first(path ORDER BY confidence DESC, path DESC) AS best_path, max(confidence) AS best_confidence, substr(first(value ORDER BY updated_at DESC, path DESC), 1, 80) AS latest_value,
 count(*) || ' entries from ' || count(DISTINCT owner) || ' agents. Latest: [' || first(path ORDER BY updated_at DESC, path DESC) || '] ' || substr(first(value ORDER BY updated_at DESC, path DESC), 1, 80) AS summary FROM p GROUP BY prefix""")
def a1_summaries(spark, d):
    return reasoning.summaries(store.latest(A.writes(spark, d)))


@query(f"WITH {A.WRITES} SELECT seq, prefix, nth FROM (SELECT seq, regexp_replace(path, '/[^/]*$', '') AS prefix, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY seq) AS nth FROM writes) WHERE nth % 10 = 0")
def a2_summary_triggers(spark, d):
    return reasoning.summary_triggers(A.writes(spark, d)).select("seq", "prefix", F.col("nth").cast("long").alias("nth"))


EVIDENCE = A.WRITES + f""", ev AS (SELECT seq, path, owner AS agent, confidence, updated_at AS ts, CASE WHEN row_number() OVER w = 1 THEN 'register' WHEN lag(owner) OVER w = owner THEN 'refresh'
 WHEN {NORM.format('value')} = lag({NORM.format('value')}) OVER w THEN 'confirm' ELSE 'contradict' END AS kind FROM writes WINDOW w AS (PARTITION BY path ORDER BY seq))"""
STATE = EVIDENCE + """, st AS (SELECT path, 1 + min_by(confidence, seq) + count(*) FILTER (WHERE kind = 'confirm') AS alpha, 2 - min_by(confidence, seq) + 2.0 * count(*) FILTER (WHERE kind = 'contradict') AS beta,
 arg_max(confidence, seq) FILTER (WHERE kind IN ('register', 'refresh')) AS base, count(*) FILTER (WHERE kind = 'confirm') AS confirmations, count(*) FILTER (WHERE kind = 'contradict') AS contradictions,
 count(DISTINCT agent) AS n_sources, max(ts) AS last_update FROM ev GROUP BY path),
eff AS (SELECT *, (1 - least(1.0, (alpha + beta - 2) / 10)) * base + least(1.0, (alpha + beta - 2) / 10) * alpha / (alpha + beta) AS effective FROM st)"""


def _states(spark, d):
    return confidence.states(confidence.evidence(A.writes(spark, d)))


@query(f"WITH {STATE} SELECT path, round(alpha, 6) AS alpha, round(beta, 6) AS beta, base, confirmations, contradictions, n_sources, last_update FROM st")
def n6_beta_states(spark, d):
    return _states(spark, d).withColumns({c: F.round(c, 6) for c in ("alpha", "beta")})


@query(f"WITH {STATE} SELECT path, round(effective, 6) AS effective FROM eff")
def x14_effective(spark, d):
    return _states(spark, d).select("path", F.round(confidence.effective(F.col("alpha"), F.col("beta"), F.col("base")), 6).alias("effective"))


@query(f"""WITH {STATE} SELECT path, round(alpha / (alpha + beta), 6) AS mean, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS variance, round(alpha + beta - 2, 6) AS strength,
 round(greatest(0.0, (p + 2.706025 / (2 * n) - 1.645 * sqrt((p * (1 - p) + 2.706025 / (4 * n)) / n)) / (1 + 2.706025 / n)), 6) AS lower FROM (SELECT *, alpha + beta AS n, alpha / (alpha + beta) AS p FROM st)""")
def x15_beta_statistics(spark, d):
    a, b = F.col("alpha"), F.col("beta")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _states(spark, d).select("path", r(confidence.mean(a, b), "mean"), r(confidence.variance(a, b), "variance"), r(confidence.strength(a, b), "strength"), r(confidence.lower_bound(a, b), "lower"))


@query(f"WITH {STATE}, now AS (SELECT max(ts) AS t FROM ev) SELECT path, round(0.5 + (effective - 0.5) * pow(2.0, -(t - last_update) / 7200), 6) AS confidence FROM eff, now")
def x16_decayed(spark, d):
    s = _states(spark, d)
    now = A.writes(spark, d).agg(F.max("updated_at").alias("t"))
    return s.crossJoin(F.broadcast(now)).select("path", F.round(confidence.decayed(confidence.effective(F.col("alpha"), F.col("beta"), F.col("base")), F.col("t") - F.col("last_update")), 6).alias("confidence"))  # one row


@query(f"WITH {STATE}, now AS (SELECT max(ts) AS t FROM ev) SELECT path, round(1 + (alpha - 1) * k, 6) AS alpha, round(1 + (beta - 1) * k, 6) AS beta, touched FROM (SELECT *, t - last_update > 720 AS touched, CASE WHEN t - last_update > 720 THEN pow(2.0, -(t - last_update) / 7200) ELSE 1.0 END AS k FROM st, now)")
def x17_bulk_decay(spark, d):
    now = A.writes(spark, d).agg(F.max("updated_at").alias("t"))
    return confidence.bulk_decay(_states(spark, d).crossJoin(F.broadcast(now)), F.col("t")).select("path", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "touched")  # one row


@query(f"""WITH {EVIDENCE}, met AS (SELECT e.seq, e.agent AS a, o.agent AS b, e.kind FROM ev e JOIN (SELECT path, agent, min(seq) AS first FROM ev GROUP BY path, agent) o ON o.path = e.path AND o.first < e.seq AND o.agent <> e.agent WHERE e.kind IN ('confirm', 'contradict'))
SELECT a, b, count(*) FILTER (WHERE kind = 'confirm') AS confirms, count(*) FILTER (WHERE kind = 'contradict') AS contradicts, round(count(*) FILTER (WHERE kind = 'confirm') / count(*), 6) AS agreement FROM met GROUP BY a, b""")
def a7_agreement(spark, d):
    return confidence.agreement(confidence.evidence(A.writes(spark, d))).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {A.CURRENT}, r AS (SELECT path, unnest(refs) AS ref FROM cur) SELECT r.path, round(exp(avg(ln(greatest(coalesce(c.confidence, 0.5), 0.01)))), 6) AS propagated FROM r LEFT JOIN cur c ON c.path = r.ref GROUP BY r.path")
def a8_through_refs(spark, d):
    rows = store.latest(A.writes(spark, d))
    return confidence.through_refs(rows, rows.select("path", F.col("confidence").alias("conf"))).withColumn("propagated", F.round("propagated", 6))


def _events(spark, d):
    return reasoning.cross_agent(A.writes(spark, d))


EVENTS = A.WRITES + f""", te AS (SELECT seq, path, split_part(path, '/', 2) AS domain, CASE WHEN {NORM.format('value')} = {NORM.format('pv')} THEN 'confirmation' ELSE 'contradiction' END AS kind, owner AS actor, o AS target, updated_at AS ts
 FROM (SELECT *, lag(owner) OVER w AS o, lag(value) OVER w AS pv FROM writes WINDOW w AS (PARTITION BY path ORDER BY seq)) WHERE o IS NOT NULL AND o <> owner)"""


@query()
def n7_trust_fold(spark, d):
    f = trust.fold(_events(spark, d))
    return f.select("agent", F.round("trust", 6).alias("trust"), "confirmations", "contradictions", "interactions", "last_active")


@query()
def k6_trust_ranking(spark, d):
    t = trust.for_domain(F.col("trust"), F.try_element_at("domains", F.lit("error")), F.coalesce(F.try_element_at("domain_events", F.lit("error")), F.lit(0)))
    return trust.fold(_events(spark, d)).select("agent", F.round(t, 6).alias("trust")).orderBy(F.desc("trust"), "agent")


@query()
def x19_trust_decay(spark, d):
    now = A.writes(spark, d).agg(F.max("updated_at").alias("t"))
    idle = F.col("t") - F.col("last_active")
    return trust.fold(_events(spark, d)).crossJoin(F.broadcast(now)).select("agent", F.round(trust.decayed(F.col("trust"), idle), 6).alias("trust"), F.array_join(F.transform(F.array_sort(F.map_entries(F.transform_values("domains", lambda _, v: F.round(trust.decayed(v, idle), 4)))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("domains"))  # one row


@query()
def j6_confidence_signal(spark, d):
    now = A.writes(spark, d).agg(F.max("updated_at").alias("t"))
    s = _states(spark, d).crossJoin(F.broadcast(now)).select("path", confidence.decayed(confidence.effective(F.col("alpha"), F.col("beta"), F.col("base")), F.col("t") - F.col("last_update")).alias("bayes"))  # one row
    p = trust.fold(_events(spark, d)).select(F.col("agent").alias("owner"), "trust", "domains", "domain_events")
    rows = store.latest(A.writes(spark, d)).select("path", "owner").join(s, "path", "left").join(p, "owner", "left")
    dom = C.domain(F.col("path"))
    t = F.coalesce(trust.for_domain(F.col("trust"), F.try_element_at("domains", dom), F.coalesce(F.try_element_at("domain_events", dom), F.lit(0))), F.lit(0.5))
    return rows.select("path", F.round(F.coalesce("bayes", F.lit(0.5)) * (0.6 + 0.4 * t), 6).alias("signal"))


@query(f"""WITH {EVENTS}, now AS (SELECT max(ts) AS t FROM te), parts AS (SELECT target AS agent, kind, true AS told, ts FROM te UNION ALL SELECT actor, kind, false, ts FROM te),
g AS (SELECT agent, count(*) FILTER (WHERE told AND kind = 'confirmation') AS confirmations, count(*) FILTER (WHERE told AND kind = 'contradiction') AS contradictions, count(*) AS interactions, max(ts) AS last_active FROM parts GROUP BY agent)
SELECT agent, confirmations, contradictions, interactions, last_active, round(CASE WHEN confirmations + contradictions > 0 THEN confirmations / (confirmations + contradictions) ELSE 0.5 END, 6) AS confirmation_rate, interactions >= 5 AS reliable, round(exp(-(t - last_active) / 3600), 6) AS activity FROM g, now""")
def a9_agent_profiles(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("ts").alias("t"))
    p = trust.profiles(e.crossJoin(F.broadcast(now)), F.lit(0.0)).drop("activity").crossJoin(F.broadcast(now))  # one row
    return p.select("agent", "confirmations", "contradictions", "interactions", "last_active", F.round("confirmation_rate", 6).alias("confirmation_rate"), "reliable", F.round(F.exp(-(F.col("t") - F.col("last_active")) / 3600), 6).alias("activity"))


WALK = EVENTS + """, ev2 AS (SELECT actor, target, kind, row_number() OVER (PARTITION BY actor, target ORDER BY seq) AS k, count(*) OVER (PARTITION BY actor, target) AS n FROM te),
wk(actor, target, k, w) AS (SELECT DISTINCT actor, target, 0::BIGINT, 0.5::DOUBLE FROM ev2 UNION ALL SELECT e.actor, e.target, e.k, greatest(0.0, least(1.0, w + CASE kind WHEN 'confirmation' THEN 0.05 ELSE -0.1 END)) FROM wk JOIN ev2 e ON e.actor = wk.actor AND e.target = wk.target AND e.k = wk.k + 1)"""


@query(f"WITH RECURSIVE {WALK} SELECT actor, target, round(arg_max(w, k), 6) AS weight FROM wk GROUP BY actor, target")
def g0_trust_edges(spark, d):
    return trust.edges(_events(spark, d)).withColumn("weight", F.round("weight", 6))


def _rank_sql(by: str, rounds: int) -> str:
    """Power iteration written out round by round over how much each nation sells to each other."""
    steps = "".join(f", s{i + 1} AS MATERIALIZED (SELECT a.agent, 0.15 / n.n + 0.85 * coalesce((SELECT sum(m.w * s.score) FROM m JOIN s{i} s ON s.agent = m.actor WHERE m.target = a.agent), 0) AS score FROM agents a, n)" for i in range(rounds))
    return f"""WITH e AS ({TRADE_SQL}), agents AS (SELECT actor AS agent FROM e UNION SELECT target FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM agents),
m AS (SELECT actor, target, weight / sum(weight) OVER (PARTITION BY {by}) AS w FROM e), s0 AS (SELECT agent, 1 / n.n AS score FROM agents, n){steps}
SELECT agent, round(score / (SELECT max(score) FROM s{rounds}), 6) AS score FROM s{rounds}"""


TRADE_SQL = "SELECT 's' || s_nationkey AS actor, 's' || c_nationkey AS target, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL"


def _trade(spark, d):
    t = lambda n: A.table(spark, d, n)
    joined = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return joined.groupBy(name("s_nationkey").alias("actor"), name("c_nationkey").alias("target")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("weight"))


@query(_rank_sql("target", 20))
def g1_pagerank(spark, d):
    return trust.pagerank(_trade(spark, d), rounds=20, epsilon=0).withColumn("score", F.round("score", 6))


@query(_rank_sql("actor", 20))
def g8_pagerank_by_out_weight(spark, d):
    return trust.pagerank(_trade(spark, d), rounds=20, epsilon=0, by="actor").withColumn("score", F.round("score", 6))


@query(f"""WITH {A.WRITES}, v AS (SELECT *, row_number() OVER w AS version, lag(seq) OVER w AS before, lead(seq) OVER w AS seq_end FROM writes WINDOW w AS (PARTITION BY path ORDER BY seq)),
born AS (SELECT seq, unnest(refs) AS ref FROM v WHERE version = 1), ps AS (SELECT born.seq, string_agg(DISTINCT v.seq::VARCHAR, ',' ORDER BY v.seq::VARCHAR) AS ps FROM born JOIN v ON v.path = born.ref AND v.seq < born.seq AND (v.seq_end IS NULL OR v.seq_end >= born.seq) GROUP BY born.seq)
SELECT v.seq, path, substr(md5(value), 1, 16) AS value_hash, version, CASE WHEN version > 1 THEN 'update' WHEN ps IS NOT NULL THEN 'derived' ELSE 'created' END AS derivation, CASE WHEN before IS NOT NULL THEN before::VARCHAR ELSE coalesce(ps, '') END AS parents FROM v LEFT JOIN ps USING (seq)""")
def g2_provenance(spark, d):
    n = provenance.nodes(A.writes(spark, d))
    return n.select("seq", "path", "value_hash", F.col("version").cast("long").alias("version"), "derivation", F.array_join(F.array_sort(F.transform("parents", lambda x: x.cast("string"))), ",").alias("parents"))


@query(f"WITH RECURSIVE {A.EDGES}, up(start, node, depth) AS (SELECT DISTINCT child, child, 0 FROM edges WHERE child LIKE 'order/%' UNION ALL SELECT start, parent, depth + 1 FROM up JOIN edges ON child = node) SELECT start, node, min(depth) AS depth FROM up GROUP BY ALL")
def g3_lineage(spark, d):
    e = A.edges(spark, d)
    return provenance.walk(e, e.where(F.col("child").startswith("order/")).select(F.col("child").alias("start")).distinct())


@query(f"WITH RECURSIVE {A.EDGES}, up(node, depth) AS (SELECT 'order/1', 0 UNION ALL SELECT parent, depth + 1 FROM up JOIN edges ON child = node) SELECT node, min(depth) AS depth FROM up GROUP BY ALL")
def g3_lineage_of_one(spark, d):
    return provenance.lineage(A.edges(spark, d), "order/1")


@query(f"WITH RECURSIVE {A.EDGES}, dn(start, node, depth) AS (SELECT DISTINCT parent, parent, 0 FROM edges WHERE parent LIKE 'region/%' UNION ALL SELECT start, child, depth + 1 FROM dn JOIN edges ON parent = node) SELECT start, node, min(depth) AS depth FROM dn GROUP BY ALL")
def g4_descendants(spark, d):
    e = A.edges(spark, d)
    return provenance.walk(e, e.where(F.col("parent").startswith("region/")).select(F.col("parent").alias("start")).distinct(), up=False)


@query(f"WITH RECURSIVE {A.EDGES}, up(start, node) AS (SELECT DISTINCT child, child FROM edges WHERE child LIKE 'customer/%' UNION SELECT start, parent FROM up JOIN edges ON child = node) SELECT start, node FROM up WHERE node NOT IN (SELECT child FROM edges)")
def g5_roots(spark, d):
    e = A.edges(spark, d)
    return provenance.roots(e, e.where(F.col("child").startswith("customer/")).select(F.col("child").alias("start")).distinct()).select("start", "node")


@query(f"WITH {A.WRITES} SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, seq DESC) AS nth FROM writes")
def g6_history(spark, d):
    from pyspark.sql import Window as W

    return A.writes(spark, d).select("path", "seq", F.row_number().over(W.partitionBy("path").orderBy(F.desc("updated_at"), F.desc("seq"))).cast("long").alias("nth"))


@query(f"WITH RECURSIVE {A.EDGES}, bi AS (SELECT child AS x, parent AS y FROM edges UNION SELECT parent, child FROM edges), p(node, depth) AS (SELECT 'nation/1', 0 UNION SELECT y, depth + 1 FROM p JOIN bi ON x = node WHERE depth < 4) SELECT min(depth) + 1 AS nodes FROM p WHERE node = 'nation/6'")
def g7_causal_chain(spark, d):
    found = provenance.chain(A.edges(spark, d).where(~F.col("child").startswith("order/")), "nation/1", "nation/6")
    return spark.createDataFrame([(len(found),)] if found else [(None,)], "nodes int")


@query(f"WITH RECURSIVE {A.EDGES}, up(start, node) AS (SELECT DISTINCT child, child FROM edges UNION SELECT start, parent FROM up JOIN edges ON child = node) SELECT start, count(DISTINCT split_part(node, '/', 1)) AS depth FROM up GROUP BY start")
def a10_trust_depth(spark, d):
    e = A.edges(spark, d)
    return provenance.walk(e, e.select(F.col("child").alias("start")).distinct()).groupBy("start").agg(F.count_distinct(F.split_part("node", F.lit("/"), F.lit(1))).alias("depth"))


SEEN = ", seen AS (SELECT path, count(*) AS version, substr(md5(arg_max(value, seq)), 1, 16) AS value_hash FROM writes WHERE updated_at <= 1705276800 GROUP BY path)"
DELTA = A.CURRENT + SEEN + """, dl AS (SELECT c.*, CASE WHEN s.version IS NULL AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.value_hash = substr(md5(c.value), 1, 16)) THEN 'new' WHEN s.version IS NULL THEN 'unchanged' WHEN c.version > s.version THEN 'updated' ELSE 'unchanged' END AS delta FROM cur c LEFT JOIN seen s USING (path))"""


def _seen(spark, d):
    return store.as_of(A.writes(spark, d), 1705276800.0).select(F.lit("r").alias("reader"), "path", "version", C.value_hash(F.col("value")).alias("value_hash"))


@query(f"WITH {DELTA} SELECT path, version, delta FROM dl")
def c1_delta(spark, d):
    return compression.delta(store.latest(A.writes(spark, d)), _seen(spark, d)).select("path", "version", "delta")


@query(f"WITH {A.CURRENT} SELECT 'r' AS reader, path, version, substr(md5(value), 1, 16) AS value_hash FROM cur")
def c2_mark_seen(spark, d):
    return compression.mark_seen(_seen(spark, d), store.latest(A.writes(spark, d)), "r")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def c3_same_text(spark, d):
    rows = A.table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.col("text").alias("value"))
    return compression.without_same_text(rows, "doc_id").select("doc_id")


@query(f"WITH {DELTA} SELECT path, round((0.5 * CASE WHEN substr(md5(value), 1, 16) IN (SELECT value_hash FROM seen) THEN 0.0 ELSE 1.0 END + 0.3 + 0.2 * confidence) / greatest(1, (length(path)+length(owner)+length(value)+23)//4) * 100, 6) AS density FROM dl")
def c5_density(spark, d):
    w = A.writes(spark, d)
    return compression.density(store.latest(w), store.as_of(w, 1705276800.0)).select("path", F.round("density", 6).alias("density"))
