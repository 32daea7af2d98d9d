"""Queries that run as streams over the whole table, with the SQL of what they must hold at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch, table
from tideline.streaming import ingest


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = scratch(spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-02, STM-07: items by source, each id once over all micro-batches."""
    rows = table(spark, sf_dir, "radar_events")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/radar_events.parquet*").select("source", "external_id")
    kept = _drained(spark, ingest.distinct_stream(stream, ["source", "external_id"]))
    return kept.groupBy("source").agg(F.count("*").alias("items"))


QUERIES = {"stm_dedup": stm_dedup}
ORACLE = {"stm_dedup": "SELECT source, count(*) AS items FROM (SELECT DISTINCT source, external_id FROM radar_events) GROUP BY source"}
