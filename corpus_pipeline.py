"""The corpus pipeline: five stages, each applying one operator to all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and the next stage reads
it again, so a lost executor never costs more than the stage it works on. All stages but the last return the columns of
``docs``, whatever else the table has and however its columns are called.

In every filtering stage a row with null text stays as it is, an empty text and a very long one are judged like any
other, and an empty table stays empty. Ties are broken by doc_id, then by a hash of the text. Each stage's docstring
gives what it does with null doc_ids and repeated rows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, packing, simhashgraph, suffixdedup, toxicity
from marlstone.llm.common import small_batches


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; the labels it is trained with are those of ``sf_dir``.

    Rows are judged one by one, so repeated rows and those with null doc_id go or stay by their text alone.
    """
    small_batches(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the least doc_id.

    Rows with null doc_id stay. Of rows repeated as they are one stays. Different texts that share a doc_id are looked at
    apart.
    """
    small_batches(spark)
    return simhashgraph.first_of_each(docs)


def repeated_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only where they come first; a document with nothing left goes.

    Rows with null doc_id stay untouched. Rows repeated as they are are one document and lose the same words.
    """
    small_batches(spark)
    return suffixdedup.without_repeats(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows are judged one by one, those with null doc_id too."""
    small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into training sequences: rows (doc_id, piece, n_tokens, bin_id, bin_offset).

    A null or empty text is one row without a bin; a null doc_id and repeated rows are packed like any.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_duplicates_out),
    ("suffix_array_dedup", repeated_passages_out),
    ("benchmark_decontamination", benchmark_out),
    ("best_fit_packing", packed),
]

#: The stages are a trained model, a graph search and a greedy packing, which SQL cannot state; the tests hold run()
#: against brute force instead.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in the place that spark.checkpoint.dir names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables are kept in the shared folder."""
    folder = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
