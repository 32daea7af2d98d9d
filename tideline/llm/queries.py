"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import formatting, history, language, leakage, names, pieces, tokens
from tideline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.copies(table(spark, sf_dir, "radar_events"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.records(table(spark, sf_dir, "radar_events"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(table(spark, sf_dir, "radar_events"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.labelled(table(spark, sf_dir, "radar_events"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeats(table(spark, sf_dir, "radar_events"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(table(spark, sf_dir, "radar_events"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.entities(table(spark, sf_dir, "radar_events"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.cleaned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_records, p3_found, p3_segments, p4_found, p5_found, p5_entities, p6_ids, p7_found, p7_cleaned, p8_pieces)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None: NFKC, merges, landmarks and the like have no SQL form; tests hold them against brute force."""
    return {}
