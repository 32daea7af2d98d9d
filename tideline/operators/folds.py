"""Ordered folds over append-only logs (STM-12, CAS form, WIN-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streaks(log: DataFrame, key: str, failed: Column, order: str = "seq") -> DataFrame:
    """STM-12: key, failures (at the end of the log since the last success), last_success, last_failure (as order values).

    Two aggregations with map-side combine, no ordered group is collected: a hot key costs as much as any other.  A
    null key is a key of its own; failed must not be null.
    """
    log = log.select(key, F.col(order).alias("_o"), failed.alias("_f"))
    ends = log.groupBy(key).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("last_success"), F.max(F.when(F.col("_f"), F.col("_o"))).alias("last_failure"))
    ends = ends.withColumnRenamed(key, "_k")
    held = log.join(ends, log[key].eqNullSafe(ends["_k"]))
    since = F.col("_f") & (F.col("last_success").isNull() | (F.col("_o") > F.col("last_success")))
    return held.groupBy(key).agg(F.count_if(since).alias("failures"), F.max("last_success").alias("last_success"), F.max("last_failure").alias("last_failure"))


def compare_and_set(log: DataFrame, key: str, initial: str) -> DataFrame:
    """The state of each key after its log of (seq, expected array<string>, target string): a step applies when the state is expected.

    A key's whole log is folded as one array, which bounds it to logs that fit a task, as state logs are.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "expected", "target")))
    folded = F.aggregate(steps, F.lit(initial), lambda s, t: F.when(F.array_contains(t["expected"], s), t["target"]).otherwise(s))
    return log.groupBy(key).agg(folded.alias("state"))


def accepted(log: DataFrame, key: str, cost: str, limit: int, order: str = "seq") -> DataFrame:
    """WIN-04: log with the flag ok: an entry counts if what counted before it and itself stay within limit.

    A rejected entry adds nothing, so this is a fold, not a running sum; a key's log is one array as above.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.expr("CAST(array() AS array<bigint>)").alias("ok"))

    def step(s: Column, e: Column) -> Column:
        fits = s["sum"] + e["c"] <= limit
        return F.struct(F.when(fits, s["sum"] + e["c"]).otherwise(s["sum"]).alias("sum"), F.when(fits, F.array_append(s["ok"], e["o"])).otherwise(s["ok"]).alias("ok"))

    kept = log.groupBy(key).agg(F.aggregate(entries, start, step)["ok"].alias("_ok"))
    return log.join(kept, key).withColumn("ok", F.array_contains("_ok", F.col(order))).drop("_ok")


def running(rows: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """rows with the running sum of value within key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))
