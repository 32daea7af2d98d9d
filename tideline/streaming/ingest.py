"""Micro-batch ingestion into append-only tables (STM-02, STM-05, STM-07, SNK-01, SNK-02)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators import dedup, screen


def distinct_stream(stream: DataFrame, keys: list[str]) -> DataFrame:
    """STM-07: the first row of each key over all time, by state; rows with a null key part share that null."""
    return stream.dropDuplicates(keys)


def has_table(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName() == "_SUCCESS" for s in fs.listStatus(p))


class Store:
    """Append-only tables in a folder all executors share; one directory for each micro-batch makes a replay idempotent."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str, schema: str, batch: int | None = None) -> DataFrame:
        """All committed batches, or those before a batch."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().toString() for s in fs.listStatus(root)] if fs.exists(root) else []
        kept = [p for p in found if (batch is None or int(p.rsplit("=", 1)[1]) < batch) and has_table(self.spark, p)]
        return self.spark.read.schema(schema).parquet(*kept) if kept else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")


EVENTS = "id string, seq bigint, source string, external_id string, url string, normalized_text string, content_hash string, reason string, duplicate_of string, published_at timestamp, source_key string"
CLOCK = "now timestamp_ntz"
METRICS = "source_key string, metric string, value bigint"


def cycle(store: Store, policy: screen.Policy, now: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: normalize, screen, drop what is known, link copies, append events and metric deltas.

    Items carry seq, their order of arrival.  What is late stays with its reason.  A batch that is played again
    writes the same directory again: it looks only at batches before it, and at the time that its first run kept.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not has_table(store.spark, f"{store.folder}/clock/batch={number}"):
            store.append("clock", store.spark.createDataFrame([(now(),)], CLOCK), number)
        moment = store.spark.read.schema(CLOCK).parquet(f"{store.folder}/clock/batch={number}").first().now
        stored = store.read("events", EVENTS, number)
        made = screen.candidates(batch.where(screen.is_valid(batch)))
        made = made.withColumn("id", F.substring(F.sha2(F.concat_ws("\n", "source", "external_id"), 256), 1, 32))
        fresh = dedup.greedy(dedup.unknown(made, stored))
        fresh = fresh.withColumn("reason", screen.first_reason(policy, moment))
        known = stored.where("reason IS NULL OR reason <> 'duplicate_content'").select("seq", "id", "content_hash")
        owners = dedup.owners(known.unionByName(fresh.select("seq", "id", "content_hash")))
        linked = fresh.join(owners, "content_hash", "left")
        copy = F.col("reason").isNull() & (F.col("owner_seq") < F.col("seq"))
        linked = linked.withColumn("duplicate_of", F.when(copy, F.col("owner"))).withColumn("reason", F.when(copy, F.lit("duplicate_content")).otherwise(F.col("reason")))
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        store.append("events", linked.select(*columns), number)
        written = store.spark.read.schema(EVENTS).parquet(f"{store.folder}/events/batch={number}")
        collected = batch.groupBy("source_key").agg(F.count("*").alias("collected"))
        kept = written.groupBy("source_key").agg(
            F.count("*").alias("inserted"), F.count_if(F.expr("reason = 'duplicate_content'")).alias("copies"),
            F.count_if(F.expr("reason IS NOT NULL AND reason <> 'duplicate_content'")).alias("filtered"),
        )
        both = collected.join(kept, collected.source_key.eqNullSafe(kept.source_key), "left").drop(kept.source_key).fillna(0)
        both = both.withColumn("exact_duplicates", F.col("collected") - F.col("inserted") + F.col("copies"))
        names = ("collected", "inserted", "exact_duplicates", "filtered")
        store.append("metrics", both.unpivot(["source_key"], list(names), "metric", "value").select("source_key", "metric", F.col("value").cast("long").alias("value")), number)

    return run


def start(items: DataFrame, store: Store, policy: screen.Policy, now: Callable[[], datetime], checkpoint: str) -> StreamingQuery:
    """STM-01, STM-02: ingest what a stream of items holds; offsets move only after the tables are written."""
    return items.writeStream.foreachBatch(cycle(store, policy, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
