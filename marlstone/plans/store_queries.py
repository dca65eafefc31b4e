"""Reads, upserts, deletes, validation and history over the write log."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.operators import store
from marlstone.plans import retrieval
from marlstone.plans.registry import query
from marlstone.sources import adapters as A

WEIGHED = (
    A.CURRENT
    + """, now AS (SELECT max(updated_at) AS t FROM cur),
refs AS (SELECT path, count(*) AS n FROM (SELECT unnest(refs) AS path FROM cur) GROUP BY path),
found AS (SELECT * FROM cur WHERE regexp_full_match(path, '{regex}'){where} ORDER BY updated_at DESC, path LIMIT 500),
sig AS (SELECT f.*, pow(2.0, -greatest(t - updated_at, 0) / 3600) AS recency, confidence AS conf, 0.5::DOUBLE AS sim,
  CASE WHEN coalesce(n, 0) > 0 THEN least(1.0, 0.3 + 0.3 * ln(1.0 + n)) ELSE 0.1 END AS ref FROM found f CROSS JOIN now LEFT JOIN refs USING (path)),
live AS (SELECT CASE WHEN var_pop(recency) > 0.001 THEN 0.45 ELSE 0 END AS a, CASE WHEN var_pop(conf) > 0.001 THEN 0.20 ELSE 0 END AS b,
  CASE WHEN var_pop(sim) > 0.001 THEN 0.15 ELSE 0 END AS c, CASE WHEN var_pop(ref) > 0.001 THEN 0.20 ELSE 0 END AS d FROM sig),
w AS (SELECT CASE WHEN a+b+c+d > 0 THEN a/(a+b+c+d) ELSE 0.45 END AS a, CASE WHEN a+b+c+d > 0 THEN b/(a+b+c+d) ELSE 0.20 END AS b,
  CASE WHEN a+b+c+d > 0 THEN c/(a+b+c+d) ELSE 0.15 END AS c, CASE WHEN a+b+c+d > 0 THEN d/(a+b+c+d) ELSE 0.20 END AS d FROM live),
scored AS (SELECT sig.*, round(recency*a + conf*b + sim*c + ref*d, 9) AS score,
  greatest(1, (length(path)+length(owner)+length(value)+23)//4) AS t_full,
  greatest(1, (length(path)+least(length(value),100)+4)//4) AS t_compact, greatest(1, length(path)//4) AS t_path FROM sig, w),
best AS (SELECT row_number() OVER (ORDER BY score DESC, path) - 1 AS rank, s.* FROM scored s
  QUALIFY row_number() OVER (ORDER BY score DESC, path) <= (SELECT greatest(10, 2 * ({budget} // greatest(1, sum(t_full)//count(*)))) FROM scored)),
pack AS (SELECT -1::BIGINT AS rank, 0::BIGINT AS used, 'none' AS form, 0::BIGINT AS tokens UNION ALL
  SELECT b.rank, p.used + CASE WHEN p.used + t_full <= {budget} THEN t_full WHEN p.used + t_compact <= {budget} THEN t_compact ELSE t_path END,
  CASE WHEN p.used + t_full <= {budget} THEN 'full' WHEN p.used + t_compact <= {budget} THEN 'compact' ELSE 'path' END,
  CASE WHEN p.used + t_full <= {budget} THEN t_full WHEN p.used + t_compact <= {budget} THEN t_compact ELSE t_path END
  FROM pack p JOIN best b ON b.rank = p.rank + 1
  WHERE p.used + t_full <= {budget} OR p.used + t_compact <= {budget} OR p.used + t_path <= {budget})"""
)


def _get_sql(regex: str, budget: int, where: str = "") -> str:
    return f"WITH RECURSIVE {WEIGHED.format(regex=regex, budget=budget, where=where)} SELECT b.rank, b.path, round(b.score, 6) AS score, p.form, p.tokens, p.used FROM pack p JOIN best b USING (rank)"


def _shown(rows):
    return rows.select(F.col("rank").cast("long").alias("rank"), "path", F.round("score", 6).alias("score"), "form", "tokens", "used")


@query(_get_sql("task/error(?:/[^/]*)*", 500))
def m0_get(spark, d):
    return _shown(retrieval.get(store.latest(A.writes(spark, d)), "task/error/**", 500))


@query(_get_sql("task/[^/]*/u1", 60))
def n3_budget_packing(spark, d):
    return _shown(retrieval.get(store.latest(A.writes(spark, d)), "task/*/u1", 60))


@query(_get_sql(".*", 800, " AND owner = 'agent-3' AND type = 'fact'"))
def f3_get_owner_type(spark, d):
    return _shown(retrieval.get(store.latest(A.writes(spark, d)), "**", 800, owner="agent-3", kind="fact"))


FLAT = "path, seq, value, owner, type, confidence, array_to_string(refs, ',') AS refs, ttl, updated_at"


def _flat(rows, *more):
    return rows.select("path", "seq", "value", "owner", "type", "confidence", C.refs_csv(F.col("refs")).alias("refs"), "ttl", "updated_at", *more)


@query(f"WITH {A.CURRENT} SELECT {FLAT}, version, created_at FROM cur")
def w1_latest(spark, d):
    return _flat(store.latest(A.writes(spark, d)), "version", "created_at")


@query(f"WITH {A.WRITES} SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq) AS version, first_value(updated_at) OVER (PARTITION BY path ORDER BY seq) AS created_at, lag(owner) OVER (PARTITION BY path ORDER BY seq) AS previous_owner, lead(seq) OVER (PARTITION BY path ORDER BY seq) AS seq_end FROM writes")
def n1_versions(spark, d):
    return store.versions(A.writes(spark, d)).select("path", "seq", F.col("version").cast("long").alias("version"), "created_at", "previous_owner", "seq_end")


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur WHERE path = 'task/error/u1'")
def s1_lookup(spark, d):
    w = A.writes(spark, d).where(F.col("path") == "task/error/u1")  # the filter goes before the aggregate
    return _flat(store.latest(w))


@query(f"WITH {A.WRITES} SELECT p AS path, EXISTS (SELECT 1 FROM writes WHERE path = p) AS found FROM (VALUES ('task/error/u1'), ('task/none/u1')) t(p)")
def s2_exists(spark, d):
    asked = spark.createDataFrame([("task/error/u1",), ("task/none/u1",)], "path string")
    there = A.writes(spark, d).select("path").join(F.broadcast(asked), "path", "left_semi").distinct().withColumn("found", F.lit(True))  # two rows asked
    return asked.join(there, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur WHERE path LIKE 'task/purchase/%'")
def s3_glob_scan(spark, d):
    return _flat(store.scan(store.latest(store.scan(A.writes(spark, d), "task/purchase/**")))).orderBy(F.desc("updated_at"), "path")


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur")
def s4_newest_first(spark, d):
    return _flat(store.latest(A.writes(spark, d))).orderBy(F.desc("updated_at"), "path")


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur WHERE owner = 'agent-3'")
def s5_by_owner(spark, d):
    return _flat(store.latest(A.writes(spark, d)).where(F.col("owner") == "agent-3"))


@query(f"WITH {A.CURRENT} SELECT count(*) AS n FROM cur")
def s6_count(spark, d):
    return store.latest(A.writes(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.VECTORS} SELECT path, label, len(v) AS dim FROM vec WHERE path IN (SELECT path FROM vec WHERE vec_id < 1)")
def s7_vector_lookup(spark, d):
    return A.vectors(spark, d).where((F.col("vec_id") < 1) & (F.size("v") == 64)).select("path", "label", F.size("v").cast("long").alias("dim"))


@query(f"WITH {A.VECTORS} SELECT path, i - 1 AS dim, round(v[i], 6) AS x FROM vec, LATERAL (SELECT unnest(range(1, 65)) AS i) WHERE len(v) = 64")
def s8_vectors_by_path(spark, d):
    v = F.col("v")
    return A.vectors(spark, d).where(F.size(v) == 64).select("path", F.posexplode(v).alias("dim", "x")).select("path", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x")).orderBy("path", "dim")


@query(f"WITH {A.VECTORS} SELECT label, len(v) AS dim, count(*) AS n FROM vec GROUP BY ALL")
def s9_vector_counts(spark, d):
    return A.vectors(spark, d).groupBy("label", F.size("v").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type IN ('error', 'signup')) WHERE n <= 50")
def s13_recent_events(spark, d):
    return store.newest(A.table(spark, d, "events").where(F.col("event_type").isin("error", "signup")), 50, time="ts", tie="event_id").select("event_type", "event_id", "user_id")


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur WHERE owner <> 'agent-5'")
def w3_delete(spark, d):
    rows = store.latest(A.writes(spark, d))
    return _flat(store.without(rows, rows.where(F.col("owner") == "agent-5")))


@query(f"WITH {A.WRITES}, gone AS (SELECT path, max(seq) AS s FROM writes WHERE type = 'decision' GROUP BY path) SELECT w.path, count(*) AS version, max(seq) AS seq FROM writes w LEFT JOIN gone USING (path) WHERE s IS NULL OR seq > s GROUP BY w.path")
def w3_delete_then_write(spark, d):
    w = A.writes(spark, d)
    return store.latest(store.without_deleted(w, w.where(F.col("type") == "decision").select("path", "seq"))).select("path", "version", "seq")


@query(f"WITH {A.CURRENT} SELECT path FROM cur WHERE ttl IN ('turn', 'session')")
def w5_purged_paths(spark, d):
    return store.latest(A.writes(spark, d)).where(F.col("ttl").isin("turn", "session")).select("path").orderBy("path")


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur WHERE ttl NOT IN ('turn', 'session')")
def w5_clear_session(spark, d):
    return _flat(store.purge(store.latest(A.writes(spark, d)), "turn", "session"))


@query(f"WITH {A.WRITES} SELECT path, max(seq) AS seq, count(*) AS version, arg_max(value, seq) AS value, coalesce(max(CASE WHEN type = 'fact' THEN seq END), -1) AS fact, coalesce(max(CASE WHEN type = 'plan' THEN seq END), -1) AS plan FROM writes GROUP BY path")
def w12_merge_metadata(spark, d):
    w = A.writes(spark, d).select("path", "seq", "value", F.create_map(F.col("type"), F.col("seq").cast("string")).alias("metadata"))
    m = store.merged(w)
    of = lambda k: F.coalesce(F.try_element_at(F.col("metadata"), F.lit(k)).cast("long"), F.lit(-1)).alias(k)
    return m.select("path", "seq", "version", "value", of("fact"), of("plan"))


@query(f"WITH {A.WRITES} SELECT owner, count(*) AS n_entries, max(updated_at) AS last_active FROM writes GROUP BY owner")
def w15_profiles(spark, d):
    return A.writes(spark, d).groupBy("owner").agg(F.count(F.lit(1)).alias("n_entries"), F.max("updated_at").alias("last_active"))


@query(f"WITH {A.WRITES}, {A.VECTORS} SELECT path, CASE WHEN label % 2 = 0 THEN 'embed' ELSE 'drop' END AS action FROM vec WHERE label % 3 <> 0")
def w9_missing_vectors(spark, d):
    v = A.vectors(spark, d)
    live, kept = v.where((F.col("label") % 2 == 0) | (F.col("label") % 3 == 0)), v.where((F.col("label") % 2 != 0) | (F.col("label") % 3 == 0))
    return store.missing_vectors(live, kept, 64)


@query(f"WITH {A.CURRENT} SELECT path, regexp_full_match(path, 'task/[^/]*/u1') AS one, regexp_full_match(path, '(?:[^/]*/)*u2') AS tail, regexp_full_match(path, 'task(?:/[^/]*)*') AS tree FROM cur")
def f1_glob(spark, d):
    p = F.col("path")
    return store.latest(A.writes(spark, d)).select(p, C.glob(p, "task/*/u1").alias("one"), C.glob(p, "**/u2").alias("tail"), C.glob(p, "task/**").alias("tree"))


@query(f"WITH {A.CURRENT} SELECT {FLAT} FROM cur ORDER BY updated_at DESC, path LIMIT 500")
def f4_candidate_cap(spark, d):
    return _flat(retrieval.candidates(store.latest(A.writes(spark, d))))


@query("""SELECT url, CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN length(url) > 512 THEN 'too long' WHEN contains(url, '..') THEN 'dot dot'
 WHEN starts_with(url, '/') OR ends_with(url, '/') THEN 'outer slash' WHEN contains(url, '//') THEN 'double slash'
 WHEN NOT regexp_full_match(url, '[a-zA-Z0-9/_.\\-]+') THEN 'characters' END AS problem FROM pages""")
def f6_path_problems(spark, d):
    return A.table(spark, d, "pages").select("url", C.path_problem(F.col("url")).alias("problem"))


@query(f"WITH {A.WRITES} SELECT seq, CASE WHEN confidence > 0.9 THEN 'confidence' WHEN owner = 'agent-6' THEN 'no owner' END AS problem FROM writes")
def f7_row_problems(spark, d):
    w = A.writes(spark, d)
    bad = w.withColumns({"confidence": F.when(F.col("confidence") > 0.9, 1.5).otherwise(F.col("confidence")), "owner": F.when(F.col("confidence") > 0.9, F.col("owner")).when(F.col("owner") == "agent-6", "").otherwise(F.col("owner"))})
    return store.refused(bad).select("seq", "problem")


@query(f"WITH {A.CURRENT} SELECT path FROM cur WHERE path LIKE 'task/error/%' OR regexp_full_match(path, 'task/[^/]*/u7')")
def f8_readable(spark, d):
    return store.readable(store.latest(A.writes(spark, d)), ["task/error/**", "task/*/u7"]).select("path")


@query(f"WITH {A.CURRENT} SELECT path, CASE WHEN confidence >= 0.9 THEN 'verified' WHEN confidence >= 0.7 THEN 'confident' WHEN confidence >= 0.5 THEN 'probable' WHEN confidence >= 0.3 THEN 'uncertain' WHEN confidence >= 0.1 THEN 'doubtful' ELSE 'discredited' END AS level FROM cur")
def f13_levels(spark, d):
    return store.latest(A.writes(spark, d)).select("path", C.level(F.col("confidence")).alias("level"))


@query(f"WITH {A.CURRENT} SELECT path, owner, type, confidence FROM cur WHERE confidence >= 0.6 AND owner IN ('agent-1', 'agent-2') AND list_has_any(refs, ['task/view/u3', 'task/click/u4', 'task/error/u5']) AND created_at > 1704153600")
def f12_search_filters(spark, d):
    wanted = F.array(*map(F.lit, ("task/view/u3", "task/click/u4", "task/error/u5")))
    return store.latest(A.writes(spark, d)).where((F.col("confidence") >= 0.6) & F.col("owner").isin("agent-1", "agent-2") & F.arrays_overlap("refs", wanted) & (F.col("created_at") > 1704153600)).select("path", "owner", "type", "confidence")


@query(f"WITH {A.WRITES} SELECT path, count(*) AS version, max(seq) AS seq, arg_max(value, seq) AS value FROM writes WHERE updated_at <= 1704844800 GROUP BY path")
def j16_as_of(spark, d):
    return store.as_of(A.writes(spark, d), 1704844800.0).select("path", "version", "seq", "value")


@query(f"WITH {A.TURNS} SELECT path, value, owner FROM turns t WHERE (conv_id, turn) IN (SELECT (conv_id, turn) FROM turns WHERE turn % 7 = 3 UNION SELECT (conv_id, turn - 1) FROM turns WHERE turn % 7 = 3 UNION SELECT (conv_id, turn + 1) FROM turns WHERE turn % 7 = 3)")
def j8_neighbours(spark, d):
    t = A.turns(spark, d)
    return store.neighbours(t, t.where(F.col("turn") % 7 == 3)).select("path", "value", "owner")


@query(f"WITH {A.CURRENT}, refs AS (SELECT path, count(*) AS n FROM (SELECT unnest(refs) AS path FROM cur) GROUP BY path) SELECT path, coalesce(n, 0) AS n_refs, round(CASE WHEN coalesce(n, 0) > 0 THEN least(1.0, 0.3 + 0.3 * ln(1.0 + n)) ELSE 0.1 END, 6) AS ref FROM cur LEFT JOIN refs USING (path)")
def j5_in_degree(spark, d):
    rows = store.latest(A.writes(spark, d))
    return rows.select("path").join(retrieval.in_degree(rows), "path", "left").select("path", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.round(retrieval.reference(F.col("n_refs")), 6).alias("ref"))


@query(f"WITH {A.WRITES} SELECT owner, seq, path FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated_at DESC, seq DESC) AS n FROM writes) WHERE n <= 500")
def n8_history_caps(spark, d):
    return store.newest(A.writes(spark, d), 500, by=("owner",)).select("owner", "seq", "path")


@query(f"WITH {A.CURRENT} SELECT path, greatest(1, (length(path)+length(owner)+length(value)+23)//4) AS t_full, greatest(1, (length(path)+least(length(value),100)+4)//4) AS t_compact, greatest(1, length(path)//4) AS t_path FROM cur")
def x1_tokens(spark, d):
    return retrieval.with_tokens(store.latest(A.writes(spark, d))).select("path", "t_full", "t_compact", "t_path")


@query(f"WITH {A.CURRENT} SELECT path, printf('[%s] (%s, confidence=%.2f): %s', path, owner, confidence, value) AS full_text, '[' || path || ']: ' || substr(value, 1, 100) || CASE WHEN length(value) > 100 THEN '...' ELSE '' END AS compact FROM cur")
def x2_render(spark, d):
    p, v = F.col("path"), F.col("value")
    return store.latest(A.writes(spark, d)).select(p, C.render_full(p, v, F.col("owner"), F.col("confidence")).alias("full_text"), C.render_compact(p, v).alias("compact"))


@query(f"WITH {A.CURRENT} SELECT path, regexp_replace(path, '/[^/]*$', '') AS prefix, split_part(path, '/', 2) AS domain, substr(md5(value), 1, 16) AS value_hash, lower(trim(value)) AS norm FROM cur")
def x3_path_parts(spark, d):
    p, v = F.col("path"), F.col("value")
    return store.latest(A.writes(spark, d)).select(p, C.prefix(p).alias("prefix"), C.domain(p).alias("domain"), C.value_hash(v).alias("value_hash"), C.normalised(v).alias("norm"))


@query(f"WITH {A.CURRENT} SELECT path, array_to_string(refs, ',') AS csv, len(refs) AS n FROM cur")
def x6_refs_round_trip(spark, d):
    rows = store.latest(A.writes(spark, d)).select("path", C.refs_csv(F.col("refs")).alias("csv"))
    return rows.withColumn("n", F.size(C.refs_array(F.col("csv"))).cast("long"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x7_metadata(spark, d):
    m = C.metadata_prefixed(C.metadata_map(F.col("props")))
    return A.table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("meta_k")).cast("long").alias("k"))


@query(f"WITH {A.CURRENT}, now AS (SELECT max(updated_at) AS t FROM cur) SELECT path, round(pow(2.0, -(t - updated_at) / 3600), 6) AS recency FROM cur, now")
def x9_recency(spark, d):
    rows = store.latest(A.writes(spark, d))
    now = rows.agg(F.max("updated_at").alias("t"))
    return rows.crossJoin(F.broadcast(now)).select("path", F.round(retrieval.recency(F.col("updated_at"), F.col("t")), 6).alias("recency"))  # one row


@query(f"WITH {A.CURRENT} SELECT count(*) AS entries, count(DISTINCT owner) AS owners, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS prefixes, max(version) AS most_versions, CAST(sum(version) AS BIGINT) AS writes FROM cur")
def a16_status(spark, d):
    return store.latest(A.writes(spark, d)).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("owner").alias("owners"), F.count_distinct(C.prefix(F.col("path"))).alias("prefixes"), F.max("version").alias("most_versions"), F.sum("version").alias("writes"))


@query(f"WITH {A.CURRENT} SELECT path, confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, created_at, path) AS n FROM cur) WHERE n > 40 AND n <= 140")
def k11_page(spark, d):
    return store.latest(A.writes(spark, d)).orderBy(F.desc("confidence"), "created_at", "path").offset(40).limit(100).select("path", "confidence")
