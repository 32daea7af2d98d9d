"""Read models over the stored tables: joins, aggregates, top-k (JON-*, AGG-*, SRT-*, WIN-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import values


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-01, AGG-12."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def scored(events: DataFrame, scores: DataFrame) -> DataFrame:
    """JON-01: events with their scores; what both tables call alike keeps the event's value."""
    taken = [c for c in scores.columns if c not in events.columns and c != "event_id"]
    return events.join(scores.select(F.col("event_id").alias("id"), *taken), "id")


def delivered_since(events: DataFrame, deliveries: DataFrame, since: datetime) -> DataFrame:
    """JON-04: events delivered at or after since."""
    ids = deliveries.where(F.col("delivered_at") >= at(since)).select(F.col("event_id").alias("id"))
    return events.join(ids, "id", "left_semi")


def prunable(events: DataFrame, before: datetime, children: list[DataFrame], statuses: tuple[str, ...] = ("FILTERED_OUT", "ARCHIVED")) -> DataFrame:
    """AGG-03, JON-03: status, n of the noise discovered before a time that no child row and no copy refers to."""
    left = events.where(F.col("status").isin(*statuses) & (F.col("discovered_at") < at(before))).select("id", "status")
    links = [c.select(F.col("event_id").alias("id")) for c in children]
    links.append(events.where("duplicate_of_event_id IS NOT NULL").select(F.col("duplicate_of_event_id").alias("id")))
    for child in links:
        left = left.join(child, "id", "left_anti")
    return counts(left, "status")


def use_rate(deliveries: DataFrame, feedback: DataFrame, action: str = "USE") -> DataFrame:
    """AGG-13: one row, use_rate_percent; null when nothing was delivered."""
    used = feedback.where(F.col("action") == action).agg(F.count_distinct("event_id").alias("used"))
    shown = deliveries.agg(F.count_distinct("event_id").alias("shown"))
    rate = F.round(F.lit(100.0) * F.col("used") / F.nullif(F.col("shown"), F.lit(0)), 1)
    return used.crossJoin(shown).select(rate.alias("use_rate_percent"))  # one row each


def score_histogram(deliveries: DataFrame, scores: DataFrame) -> DataFrame:
    """AGG-14, JON-12: deliveries by tens of the score."""
    bucket = (F.expr("total div 10") * 10).cast("long").alias("bucket")
    return deliveries.select("event_id").join(scores.select("event_id", "total"), "event_id").groupBy(bucket).agg(F.count("*").alias("n"))


def source_quality(events: DataFrame, deliveries: DataFrame, outbox: DataFrame) -> DataFrame:
    """AGG-15, JON-11: source_key, cards, approved: distinct events delivered and approved.

    The children are made distinct first, so that no fan-out is shuffled.
    """
    cards = deliveries.select(F.col("event_id").alias("id")).distinct().withColumn("card", F.lit(1))
    packages = outbox.select(F.col("event_id").alias("id")).distinct().withColumn("package", F.lit(1))
    # ids repeat in no table that keeps its keys; where one does, distinct ids still count once
    joined = events.select("id", "source_key").distinct().join(cards, "id", "left").join(packages, "id", "left")
    return joined.groupBy("source_key").agg(F.count("card").alias("cards"), F.count("package").alias("approved"))


def duplicate_audit(rows: DataFrame, *keys: str) -> DataFrame:
    """AGG-16: for each key column, rows with a value less distinct values."""
    return rows.agg(*((F.count(k) - F.count_distinct(k)).alias(f"{k}_repeats") for k in keys))


def counter_totals(runs: DataFrame, names: list[str], since: datetime) -> DataFrame:
    """AGG-07: metric, total over the runs started since, of counters kept as JSON; missing counters are 0."""
    held = runs.where(F.col("started_at") >= at(since)).select(F.explode(values.counters(F.col("counters_json"), names)).alias("metric", "value"))
    return held.groupBy("metric").agg(F.sum("value").alias("total"))


def source_counters(events: DataFrame) -> DataFrame:
    """AGG-08: counters of each source_key; null is a key of its own."""
    kept, copy = F.col("filter_reason").isNull(), F.col("filter_reason") == "duplicate_content"
    return events.groupBy("source_key").agg(
        F.count("*").alias("collected"), F.count_if(copy).alias("duplicates"),
        F.count_if(~kept & ~copy).alias("filtered"), F.count_if(kept).alias("kept"),
    )


def metric_deltas(deltas: DataFrame) -> DataFrame:
    """AGG-02, SNK-02: additive metrics: the sums of appended run_id, source_key, metric, value rows."""
    return deltas.groupBy("source_key", "metric").agg(F.sum("value").alias("value"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """WIN-02: the last row of each key; order must be total.  Spark keeps only the first rank before its shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """WIN-03: the number of each row within its key, from 1."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """SRT-*: the first k rows of a total order; each task keeps k rows."""
    return rows.orderBy(*order).limit(k)


def deliverable(events: DataFrame, scores: DataFrame, statuses: tuple[str, ...], least: int, k: int) -> DataFrame:
    """SRT-02, FLT-10: scored events that may be delivered, best first, newest first, then by id."""
    fits = F.col("status").isin(*statuses) & ((F.col("total") >= least) | (F.col("source_key") == "manual"))
    return top(scored(events, scores).where(fits), k, F.desc("total"), F.desc("published_at"), F.col("id"))


def linked(events: DataFrame) -> DataFrame:
    """JON-09: duplicate links to rows that exist, null for others."""
    ids = events.select(F.col("id").alias("duplicate_of_event_id"), F.col("id").alias("link")).distinct()
    return events.join(ids, "duplicate_of_event_id", "left")
