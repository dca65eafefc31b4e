"""Measures of retrieval and simple baselines to hold it against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def answer_text(text: Column) -> Column:
    """Lower case without articles and punctuation, white space as single blanks; letters of any script stay."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def exact_match(prediction: Column, truth: Column) -> Column:
    return F.when(answer_text(prediction) == answer_text(truth), 1.0).otherwise(0.0)


def token_f1(prediction: Column, truth: Column) -> Column:
    """Harmonic mean of precision and recall over the sets of words; 1 where both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(answer_text(c), " "), lambda w: w != ""))
    p, t = words(prediction), words(truth)
    both = F.size(F.array_intersect(p, t))
    return F.when((F.size(p) == 0) & (F.size(t) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(t)))


def chunks(docs: DataFrame, words: int = 500, key: str = "doc_id") -> DataFrame:
    """Texts cut into runs of so many words: (key, chunk, text, n_words)."""
    each = docs.where(F.col("text").isNotNull()).select(key, F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda w: w != "").alias("_w"))
    n = F.ceil(F.size("_w") / words)
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = each.select(key, F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice(F.col("_w"), i * words + 1, F.lit(words)).alias("w")))).alias("c"))
    return part.select(key, F.col("c.i").alias("chunk"), F.array_join("c.w", " ").alias("text"), F.size("c.w").alias("n_words"))


def within(rows: DataFrame, budget: int, tokens: str, by: str, *order) -> DataFrame:
    """Rows in order as long as their running sum stays within the budget: it ends at the first that does not fit."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def paragraphs(docs: DataFrame, chars: int = 2000, overlap: int = 0, key: str = "doc_id") -> DataFrame:
    """Lines gathered into chunks of at most ``chars`` characters where lines allow; each chunk may begin with the last
    characters of the one before."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc, line):
        joined = F.when(acc["cur"] == "", line).otherwise(F.concat(acc["cur"], F.lit("\n"), line))
        tail = F.concat(F.substring(acc["cur"], -overlap, overlap), F.lit("\n")) if overlap else F.lit("")
        full = (acc["cur"] != "") & (F.length(joined) > chars)
        return F.when(full, F.struct(F.array_append(acc["out"], acc["cur"]).alias("out"), F.concat(tail, line).alias("cur"))).otherwise(F.struct(acc["out"].alias("out"), joined.alias("cur")))

    done = lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["cur"]))
    return docs.where(F.col("text").isNotNull()).select(key, F.posexplode(F.aggregate(lines, zero, step, done)).alias("chunk", "text"))


def retained(final: Column, truth: Column, tolerance: float = 0.05) -> Column:
    """Whether a number near enough to ``truth`` is still in the text."""
    numbers = F.transform(F.regexp_extract_all(final, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.exists(numbers, lambda x: F.abs(x - truth) / (F.abs(truth) + 0.01) < tolerance)


def retrieval_scores(found: DataFrame, relevant: DataFrame, by: str = "query", item: str = "path") -> DataFrame:
    """Precision, recall and F1 of each query over sets of items."""
    f = found.select(by, item).distinct().withColumn("_f", F.lit(1))
    r = relevant.select(by, item).distinct().withColumn("_r", F.lit(1))
    g = f.join(r, [by, item], "full_outer").groupBy(by).agg(F.count_if(F.col("_f").isNotNull() & F.col("_r").isNotNull()).alias("hits"), F.count("_f").alias("found"), F.count("_r").alias("relevant"))
    p, q = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0), F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0)
    return g.withColumns({"precision": p, "recall": q}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def rates(rows: DataFrame) -> DataFrame:
    """Derived rates of a run's counters: share of tokens read in vain and to use, contradictions found, F1."""
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    found = F.col("contradictions_detected") + F.col("contradictions_missed")
    p, r = F.col("context_precision"), F.col("context_recall")
    return rows.withColumns({
        "token_waste_ratio": part(F.col("redundant_tokens"), F.col("total_tokens_read")), "token_efficiency": part(F.col("useful_tokens"), F.col("total_tokens_read")),
        "contradiction_detection_rate": part(F.col("contradictions_detected"), found), "f1_score": part(2 * p * r, p + r),
    })


def ranked_within(ranked: DataFrame, budget: int, tokens: str = "tokens", rank: str = "rank", cut: bool = False, least: int = 20) -> DataFrame:
    """Ranked rows as far as the budget goes, ended by the first that overflows it; with ``cut`` that one is shortened to
    what is left, if that is more than ``least`` tokens. Adds taken. The rows are a top k, so one window holds them."""
    used = F.sum(tokens).over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    listed = ranked.withColumn("_u", used).withColumn("_over", (F.col("_u") > budget).cast("int"))
    listed = listed.withColumn("_n", F.sum("_over").over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("_u") - F.col(tokens))
    keep = F.col("_n") == 0
    if cut:
        keep = keep | ((F.col("_n") == 1) & (F.col("_over") == 1) & (left > least))
    return listed.where(keep).withColumn("taken", F.when(F.col("_over") == 1, left).otherwise(F.col(tokens)).cast("bigint")).drop("_u", "_over", "_n")
