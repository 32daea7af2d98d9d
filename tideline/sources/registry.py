"""Registry and union of sources (SRC-08, SRC-17..19, SET-01)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schemas import ITEM
from tideline.session import materialize

#: Sources that are read at the same time.
AT_ONCE = 8


@dataclass(frozen=True)
class Source:
    name: str
    build: Callable[[SparkSession], DataFrame]
    enabled: bool = True


def memory(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """SRC-18: rows in memory as items."""
    return spark.createDataFrame(rows, ITEM)


def collect(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame, dict[str, str]]:
    """Items of all enabled sources with ``rank``, the source's place, and the errors of those that failed.

    Each source is read by itself into the shared folder, AT_ONCE at a time, so one that fails when planned or when
    run leaves the others whole.
    """

    def read(place: tuple[int, Source]) -> DataFrame | Exception:
        rank, source = place
        try:
            return materialize(source.build(spark).withColumn("rank", F.lit(rank)), "source")
        except Exception as e:  # noqa: BLE001
            return e

    enabled = [(rank, s) for rank, s in enumerate(sources) if s.enabled]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = list(pool.map(read, enabled))
    errors = {s.name: type(r).__name__ for (_, s), r in zip(enabled, got, strict=True) if isinstance(r, Exception)}
    empty = spark.createDataFrame([], ITEM + ", rank int")
    return reduce(DataFrame.unionByName, [r for r in got if not isinstance(r, Exception)], empty), errors
