"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, langid, licenses, lmscore, packing, simhashgraph, suffixdedup, syncmers, tokencount, toxicity
from marlstone.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_compression_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(read(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_spans(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhashgraph.groups(read(spark, sf_dir, "documents"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_compression_score,
            op3_toxicity,
            op4_license_scan,
            op5_token_counts,
            op6_suffix_array_dedup,
            op7_best_fit_packing,
            op8_simhash_near_dedup,
            op9_syncmers,
            op10_decontamination,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_array_dedup": suffixdedup.sql(), "op9_syncmers": syncmers.sql()}
