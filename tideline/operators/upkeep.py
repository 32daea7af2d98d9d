"""Upkeep views over append-only tables: expiry, interrupted runs, key-value state, next slots, budgeted top-k (STM-09, STM-13, STM-14, SRT-08, SRT-10)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import read_models


def expired(events: DataFrame, before: datetime, statuses: Sequence[str], target: str = "EXPIRED") -> DataFrame:
    """STM-09: events with the status after expiry; only the given statuses expire, a null discovered_at never."""
    old = F.col("status").isin(*statuses) & (F.col("discovered_at") < read_models.at(before))
    return events.withColumn("status", F.when(old, F.lit(target)).otherwise(F.col("status")))


def closed_runs(runs: DataFrame, now: datetime, running: str = "RUNNING", failed: str = "FAILED") -> DataFrame:
    """STM-14: runs with those still running closed as failed at now."""
    cut = F.col("status") == running
    return runs.withColumns({
        "status": F.when(cut, F.lit(failed)).otherwise(F.col("status")),
        "finished_at": F.coalesce("finished_at", F.when(cut, read_models.at(now))),
        "error_summary": F.coalesce("error_summary", F.when(cut, F.lit("interrupted"))),
    })


def state(log: DataFrame) -> DataFrame:
    """STM-13, CAS-15: key, value: the last value of each key of a log of seq, key, value; combined before its shuffle."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def is_alive(heartbeat: Column, now: datetime, most: timedelta = timedelta(minutes=3)) -> Column:
    """STM-13: a heartbeat younger than ``most``; false for none."""
    return F.coalesce(heartbeat.cast("timestamp_ntz") > read_models.at(now - most), F.lit(False))


def next_slot(after: Column, times: Sequence[str], zone: str) -> Column:
    """SRT-10: the first of the zone's clock times strictly after a UTC time, in UTC; a day's change of clock is kept to."""
    today = F.date_trunc("day", F.from_utc_timestamp(after, zone))
    days = [F.date_format(today + F.expr(f"INTERVAL {d} DAY"), "yyyy-MM-dd") for d in range(3)]
    slots = [F.to_utc_timestamp(F.to_timestamp(F.concat(d, F.lit(f" {t}")), "yyyy-MM-dd HH:mm"), zone) for d in days for t in times]
    return F.array_min(F.filter(F.array(*slots), lambda s: s > after))


def clock_times(text: str) -> list[str]:
    """DTE-F9: two or three distinct HH:MM of a comma-separated list, in order."""
    found = sorted({datetime.strptime(t.strip(), "%H:%M").strftime("%H:%M") for t in text.split(",") if t.strip()})
    if not 2 <= len(found) <= 3:
        raise ValueError("two or three distinct times are needed")
    return found


def allowance(deliveries: DataFrame, since: datetime, cards: int, daily: int) -> DataFrame:
    """SRT-08: one row, allowed: what may still be delivered, from 0 to cards."""
    sent = deliveries.where(F.col("delivered_at") >= read_models.at(since)).agg(F.count("*").alias("sent"))
    return sent.select(F.greatest(F.lit(0), F.least(F.lit(cards), F.lit(daily) - F.col("sent"))).cast("long").alias("allowed"))


def budgeted(ranked: DataFrame, allowed: DataFrame, most: int, *order: Column) -> DataFrame:
    """SRT-08: the first ``allowed`` of at most ``most`` rows; the one-row bound is joined to the top rows only."""
    from pyspark.sql import Window

    best = read_models.top(ranked, most, *order)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of ``most`` rows
    return placed.join(F.broadcast(allowed), F.col("place") <= F.col("allowed")).drop("allowed")


def reported(rows: DataFrame) -> DataFrame:
    """SNK-08: each row as one JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("report"))
