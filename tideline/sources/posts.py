"""Pages of posts in JSON (SRC-13..15)."""

from __future__ import annotations

import html
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import values
from tideline.functions.text import _mapped

_unescaped = _mapped(html.unescape)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page, json: one JSON document a file; what is no JSON object has null json."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), "value")
    return raw.select("page", F.try_parse_json("value").alias("json"))


def items(found: DataFrame, source_key: str) -> DataFrame:
    """Items of all posts of the pages; malformed posts (no id, text or time) are left out.

    The author is the user of that id on the page; a long text goes before the short one.
    """
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    posts = found.select("json", F.explode(F.try_variant_get("json", "$.data", "array<variant>")).alias("p"))
    users = F.coalesce(F.try_variant_get("json", "$.includes.users", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))
    author = get("p", "$.author_id")
    count = lambda *paths: F.coalesce(*(get("p", f"$.public_metrics.{x}", "int") for x in paths), F.lit(0))
    name = get("user", "$.username")
    made = posts.withColumn("user", F.when(author.isNotNull(), F.try_element_at(F.filter(users, lambda u: F.try_variant_get(u, "$.id", "string") == author), F.lit(-1))))
    made = made.withColumns({
        "external_id": get("p", "$.id"), "author_id": author, "author_handle": F.when(name.rlike("^[A-Za-z0-9_]{1,15}$"), name),
        "text": F.coalesce(F.nullif(get("p", "$.note_tweet.text"), F.lit("")), F.nullif(get("p", "$.note_post.text"), F.lit("")), get("p", "$.text")),
        "published_at": values.iso_time(get("p", "$.created_at")),
    })
    made = made.where("external_id IS NOT NULL AND text IS NOT NULL AND text <> '' AND published_at IS NOT NULL")
    url = F.concat(F.lit("https://x.com/"), F.coalesce("author_handle", F.lit("i/web")), F.lit("/status/"), "external_id")
    engagement = F.struct(
        count("like_count").alias("likes"), count("retweet_count", "repost_count").alias("reposts"), count("reply_count").alias("replies"),
        count("quote_count").alias("quotes"), get("p", "$.public_metrics.impression_count", "int").alias("views"),
    )
    return made.select(
        F.lit("x").alias("source"), "external_id", url.alias("url"), "author_id", "author_handle", get("user", "$.name").alias("author_display_name"),
        _unescaped("text").alias("original_text"), get("p", "$.lang").alias("language"), "published_at", engagement.alias("engagement"),
        F.to_json(F.struct(F.col("external_id").alias("id"), "author_id", get("p", "$.lang").alias("lang"))).alias("raw_payload_json"),
        F.lit(source_key).alias("source_key"),
    )


def newest_id(found: DataFrame) -> DataFrame:
    """SRC-13: newest_id over the pages, by number."""
    ids = found.select(F.explode(F.try_variant_get("json", "$.data", "array<variant>")).alias("p")).select(F.try_variant_get("p", "$.id", "string").try_cast("bigint").alias("i"))
    return ids.agg(F.max("i").cast("string").alias("newest_id"))


def since(cursor: str | None, now: datetime, spark: SparkSession, *, most_days: int = 6, lookback_hours: int = 24) -> DataFrame:
    """SRC-14: since_id of a cursor young enough to search from, else start_time."""
    made = values.snowflake_time(F.lit(cursor).cast("string"))
    young = F.coalesce(made > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {most_days * 24 + lookback_hours} HOUR"), F.lit(False))
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lookback_hours} HOUR")
    return spark.range(1).select(F.when(young, F.lit(cursor)).alias("since_id"), F.when(~young, start).alias("start_time"))
