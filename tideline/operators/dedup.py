"""Exact duplicates by id, URL and content, in order of arrival (SET-02..04, JON-05..08, AGG-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.urls import SHARED_URL_SOURCES
from tideline.session import materialize


def first_by(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """SET-02: the first row of each key, and every row that lacks a part of it.

    The minimum is combined before the shuffle, so a hot key is no hot task; null keys repeat nothing.
    """
    has_all = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    firsts = rows.where(has_all).groupBy(*keys).agg(F.min(order).alias("_first"))
    kept = rows.where(has_all).join(firsts.withColumnRenamed("_first", order), [*keys, order], "left_semi")
    return kept.unionByName(rows.where(f"NOT ({has_all})"))


def unknown(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """JON-05, JON-06: rows of batch whose id and, where a source's items have URLs of their own, URL are not stored."""
    ids = stored.select("source", "external_id").distinct()
    urls = stored.where(~F.col("source").isin(*SHARED_URL_SOURCES)).select("source", "url").distinct()
    return batch.join(ids, ["source", "external_id"], "left_anti").join(urls, ["source", "url"], "left_anti").select(*batch.columns)


def _kept(bound: DataFrame) -> DataFrame:
    """seq of the rows that are kept, of seq, source, external_id, url, in rounds over the least rows of their keys.

    A row that is the first undecided one of both its keys is kept, a row with a key of a kept one is not; both are
    minima, combined before their shuffle.  Rounds are as many as the longest chain of rows that hang on one another.
    """
    of = lambda name: F.struct(F.lit(name).alias("type"), "source", F.col(name).alias("value"))
    undecided = bound.select("seq", F.explode(F.array(of("external_id"), of("url"))).alias("key")).where("key.value IS NOT NULL")
    undecided = materialize(undecided, "greedy")
    out = None
    while True:
        heads = undecided.groupBy("key").agg(F.min("seq").alias("head"))
        first = undecided.join(heads, "key").groupBy("seq").agg(F.min("head").alias("head"), F.collect_list("key").alias("keys")).where("head = seq")
        first = materialize(first.select("seq", "keys"), "greedy")
        part = first.select("seq")
        out = part if out is None else out.unionAll(part)
        taken = undecided.join(first.select(F.explode("keys").alias("key")), "key", "left_semi").select("seq").distinct()
        undecided = materialize(undecided.join(taken, "seq", "left_anti"), "greedy")
        if not undecided.limit(1).count():
            return out


def greedy(rows: DataFrame) -> DataFrame:
    """SET-03: rows kept when neither their id nor their URL was kept before within the source, in seq order.

    Rows whose id and URL are each alone in the source need no order and pass; the others are decided in rounds, with
    their keys only.  A source whose items share URLs is decided by id alone, by
    aggregation.  Null ids and URLs repeat nothing; seq is unique and not null.
    """
    keyed = rows.select("seq", "source", "external_id", "url").where("source IS NOT NULL AND external_id IS NOT NULL")
    shared = F.col("source").isin(*SHARED_URL_SOURCES)
    by_id = keyed.where(shared).groupBy("source", "external_id").agg(F.min("seq").alias("seq")).select("seq")
    own = keyed.where(~shared)
    twice_id = own.groupBy("source", "external_id").agg(F.count("*").alias("n")).where("n > 1")
    twice_url = own.where("url IS NOT NULL").groupBy("source", "url").agg(F.count("*").alias("n")).where("n > 1")
    marked = own.join(twice_id.select("source", "external_id", F.lit(True).alias("a")), ["source", "external_id"], "left")
    marked = marked.join(twice_url.select("source", "url", F.lit(True).alias("b")), ["source", "url"], "left")
    free = marked.where("a IS NULL AND b IS NULL").select("seq")
    bound = marked.where("a OR b").select("source", "seq", "external_id", "url")
    followed = _kept(bound)
    nameless = rows.where("source IS NULL OR external_id IS NULL").select("seq")
    return rows.join(by_id.unionAll(free).unionAll(followed).unionAll(nameless), "seq", "left_semi")


def owners(rows: DataFrame) -> DataFrame:
    """AGG-05: content_hash, owner, owner_seq: the first row of each hash."""
    firsts = rows.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("seq").alias("owner_seq"))
    names = rows.select(F.col("seq").alias("owner_seq"), F.col("id").alias("owner"))
    return firsts.join(names, "owner_seq").select("content_hash", "owner", "owner_seq")


def content_links(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """SET-04: rows with duplicate_of: the owner of the text, for a row without a reason of its own that is not the owner.

    A row with a reason still owns its hash.  A null hash has no owner.
    """
    held = rows.join(owners(rows), "content_hash", "left")
    copy = F.col(reason).isNull() & (F.col("owner_seq") < F.col("seq"))
    return held.withColumn("duplicate_of", F.when(copy, F.col("owner"))).drop("owner", "owner_seq")


def earlier_copies(rows: DataFrame) -> DataFrame:
    """JON-08: rows that an earlier row has the content hash of."""
    firsts = rows.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("seq").alias("_first"))
    return rows.join(firsts, "content_hash").where("_first < seq").select(*rows.columns)
