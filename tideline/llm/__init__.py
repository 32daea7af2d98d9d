"""Operators for training data made of text.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries.queries()


def oracle_sql() -> dict[str, str]:
    return _queries.oracle_sql()
