"""JSON in and out, settings, and question sets."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, value string, owner string, type string, confidence double, refs array<string>, ttl string, metadata map<string,string>"


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """The list under ``entries`` of one or more JSON files, with the defaults of a write filled in."""
    doc = spark.read.schema(f"entries array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ENTRY.split(', '))}>>").json(path, multiLine=True)
    rows = doc.select(F.explode("entries").alias("e")).select("e.*")
    fill = {"type": F.lit("fact"), "confidence": F.lit(1.0), "refs": F.array().cast("array<string>"), "ttl": F.lit("session"), "metadata": F.expr("cast(map() as map<string,string>)"), "owner": F.lit("import")}
    return rows.withColumns({k: F.coalesce(k, v) for k, v in fill.items()})


def export_json(rows: DataFrame, path: str) -> None:
    """All rows, a JSON object a line, written by all tasks."""
    rows.write.mode("overwrite").json(path)


def settings(file: str | None = None, prefix: str = "MARLSTONE_", **overrides) -> dict:
    """Settings of a JSON file, over which go environment variables, over which go arguments."""
    out = json.loads(Path(file).read_text()) if file else {}
    out |= {k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix)}
    return out | {k: v for k, v in overrides.items() if v is not None}


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets whose context is a list of titles and a list of lists of sentences, as one text a question."""
    raw = spark.read.json(path)
    parts = F.zip_with("context.title", "context.sentences", lambda t, s: F.concat(t, F.lit(": "), F.array_join(s, " ")))
    return raw.select("id", F.array_join(parts, "\n\n").alias("context"), "question", "answer")


def long_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question sets whose context is one long text; fields that are missing are empty."""
    raw = spark.read.schema("id string, context string, question string, answer string, length string, difficulty string").json(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])


def save_state(spark: SparkSession, folder: str, key: str, state: dict) -> None:
    """State of the store under a key, as JSON with sorted keys; a later one takes its place when it is read."""
    row = [(key, json.dumps(state, sort_keys=True), time.time_ns())]
    spark.createDataFrame(row, "key string, payload string, at bigint").write.mode("append").parquet(folder)


def load_state(spark: SparkSession, folder: str, key: str) -> dict | None:
    """The last state that was saved under a key; None where there is none or it is no JSON object."""
    try:
        row = spark.read.parquet(folder).where(F.col("key") == key).agg(F.max_by("payload", "at").alias("p")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    try:
        out = json.loads(row["p"]) if row["p"] is not None else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def save_table(rows: DataFrame, folder: str) -> None:
    """A graph's or a ledger's table (provenance nodes, confidence states, trust profiles), as it is."""
    rows.write.mode("overwrite").parquet(folder)


def load_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def capabilities(spark: SparkSession, vectors: bool) -> DataFrame:
    """What the store can do, and which of it is the best."""
    return spark.createDataFrame([("text", True, not vectors), ("embedding", vectors, vectors), ("tensor", False, False)], "channel string, available boolean, best boolean")
