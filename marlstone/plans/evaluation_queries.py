"""Baselines and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import store
from marlstone.plans.registry import query
from marlstone.sources import adapters as A

WS = r"string_split_regex(text, '[ \t\n\r\f\v]+')"
CHUNKS = f"w AS (SELECT doc_id, list_filter({WS}, lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL), ch AS (SELECT doc_id, i AS chunk, ws[i * 500 + 1:i * 500 + 500] AS cw FROM w, LATERAL (SELECT unnest(range(0, CAST(ceil(len(ws) / 500.0) AS BIGINT))) AS i))"


@query("SELECT conv_id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def bx1_history_text(spark, d):
    t = A.table(spark, d, "conversations")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("text")).alias("t"))))
    return t.groupBy("conv_id").agg(F.array_join(rows["t"], "\n").alias("text"))


@query(f"WITH {A.CURRENT} SELECT path, value FROM cur WHERE starts_with(path, 'task/pur')")
def bx2_prefix_read(spark, d):
    return store.latest(A.writes(spark, d).where(F.col("path").startswith("task/pur"))).select("path", "value")


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(cw) AS INTEGER) AS n_words, md5(array_to_string(cw, ' ')) AS h FROM ch")
def bx4_word_chunks(spark, d):
    return E.chunks(A.table(spark, d, "documents")).select("doc_id", "chunk", "n_words", F.md5("text").alias("h"))


@query(f"WITH {CHUNKS}, u AS (SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(sum(length(array_to_string(cw, ' ')) // 4) OVER (PARTITION BY doc_id ORDER BY chunk) AS BIGINT) AS used FROM ch) SELECT * FROM u WHERE used <= 2000")
def n5_chunks_within_budget(spark, d):
    c = E.chunks(A.table(spark, d, "documents")).withColumn("tokens", F.floor(F.length("text") / 4))
    return E.within(c, 2000, "tokens", "doc_id", "chunk").select("doc_id", "chunk", "used")


@query("SELECT doc_id, md5(substr(text, 1, 8000)) AS h, least(length(text), 8000) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def bx5_truncated_context(spark, d):
    return A.table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(F.substring("text", 1, 8000)).alias("h"), F.floor(F.least(F.length("text"), F.lit(8000)) / 4).alias("tokens"))


@query(f"WITH {A.WRITES} SELECT seq, list_bool_or(list_transform(regexp_extract_all(value, '[0-9]+'), lambda x: abs(CAST(x AS DOUBLE) - floor(e.value_0)) / (abs(floor(e.value_0)) + 0.01) < 0.05)) AS kept FROM writes JOIN (SELECT event_id, value AS value_0 FROM events) e ON event_id = seq")
def bx6_retention(spark, d):
    truth = A.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor("value").cast("double").alias("truth"))
    return A.writes(spark, d).join(truth, "seq").select("seq", E.retained(F.col("value"), F.col("truth")).alias("kept"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def a19_percentiles(spark, d):
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    return A.table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


NORMAL = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"
F1 = f"n AS (SELECT conv_id, turn, {NORMAL.format('text')} AS t, {NORMAL.format('prev')} AS p FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL), s AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(p, ' '), lambda x: x <> '')) AS b FROM n)"


@query(f"WITH {F1} SELECT conv_id, turn, CASE WHEN t = p THEN 1.0::DOUBLE ELSE 0.0 END AS exact, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM s")
def a18_answer_scores(spark, d):
    from pyspark.sql import Window as W

    t = A.table(spark, d, "conversations").select("conv_id", "turn", "text")
    t = t.withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where(F.col("prev").isNotNull())
    return t.select("conv_id", "turn", E.exact_match(F.col("text"), F.col("prev")).alias("exact"), F.round(E.token_f1(F.col("text"), F.col("prev")), 6).alias("f1"))


@query("""WITH f AS (SELECT DISTINCT o_orderpriority AS query, o_custkey AS item FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_orderpriority AS query, o_custkey AS item FROM orders WHERE o_totalprice > 100000),
h AS (SELECT coalesce(f.query, r.query) AS query, count(*) FILTER (WHERE f.item IS NOT NULL AND r.item IS NOT NULL) AS hits, count(f.item) AS found, count(r.item) AS relevant FROM f FULL JOIN r ON f.query = r.query AND f.item = r.item GROUP BY 1)
SELECT query, hits, found, relevant, round(CASE WHEN found > 0 THEN hits / found ELSE 0 END, 6) AS precision, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS recall, round(CASE WHEN hits > 0 THEN 2.0 * (hits / found) * (hits / relevant) / (hits / found + hits / relevant) ELSE 0 END, 6) AS f1 FROM h""")
def a20_precision_recall(spark, d):
    o = A.table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "query", "o_custkey": "item"})
    s = E.retrieval_scores(o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 100000"), "query", "item")
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT b AS budget, count(*) AS n, round(avg(least(length(text) // 4, b)), 6) AS tokens, round(avg(1 - least(length(text) // 4, b) / greatest(1, length(text) // 4)), 6) AS reduction FROM documents, (VALUES (500), (1000), (2000), (4000)) t(b) WHERE text IS NOT NULL GROUP BY b")
def bx8_evaluation_by_budget(spark, d):
    t = A.table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.floor(F.length("text") / 4).alias("n"))
    each = t.withColumn("budget", F.explode(F.array(*map(F.lit, (500, 1000, 2000, 4000)))))
    used = F.least("n", "budget")
    return each.groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(used), 6).alias("tokens"), F.round(F.avg(1 - used / F.greatest(F.lit(1), F.col("n"))), 6).alias("reduction"))


@query()
def x34_paragraph_chunks(spark, d):
    return E.paragraphs(A.table(spark, d, "documents"), 2000, 300).select("doc_id", "chunk", F.length("text").alias("n_chars"))
