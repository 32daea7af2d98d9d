"""Quote files: gzipped JSON lines, one article with its quotes a line, one file a minute (SRC-01..07)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import values
from tideline.schemas import EMPTY

SOURCE_KEY = "gdelt:gqg"
# Most characters of a quote and of its context, most bytes of a line.
QUOTE_CHARS, CONTEXT_CHARS, LINE_BYTES = 2000, 500, 4 << 20

_OBJECT = "json is not null and schema_of_variant(json) like 'OBJECT%'"


def wanted_minutes(spark: SparkSession, cursor: str | None, now: datetime, *, lookback_minutes: int = 60, lag_minutes: int = 2, most: int = 1440) -> DataFrame:
    """SRC-01, SRC-06, STM-03, STM-05: minute, file: the files from the cursor (or the lookback) to now less the lag, at most ``most``.

    A cursor that cannot be read counts as none; one ahead of now gives no minute.
    """
    end = values.minute(F.lit(now).cast("timestamp")) - F.expr(f"INTERVAL {lag_minutes} MINUTE")
    start = F.coalesce(F.try_to_timestamp(F.lit(cursor).cast("string"), F.lit(values.MINUTE_FORMAT)), end - F.expr(f"INTERVAL {lookback_minutes} MINUTE"))
    start = values.minute(start)
    stop = F.least(end, start + F.expr(f"INTERVAL {most - 1} MINUTE"))
    found = spark.range(1).select(F.explode(F.when(start <= stop, values.minutes(start, stop))).alias("minute"))
    return found.withColumn("file", F.concat(F.date_format("minute", values.MINUTE_FORMAT), F.lit(".gqg.json.gz")))


def progress(outcomes: DataFrame, cursor: str | None, now: datetime, *, lookback_minutes: int = 60, lag_minutes: int = 2) -> DataFrame:
    """SRC-07: cursor, error_code after a run over minute, error (null for a file read, a gap or one left out as too large).

    The minutes before the first failing one are kept and that one comes again; without any the cursor is null, which is
    no success.  A cursor ahead of now is the error gdelt_cursor_ahead.
    """
    moment = values.minute(F.lit(now).cast("timestamp"))
    lookback = moment - F.expr(f"INTERVAL {lag_minutes + lookback_minutes} MINUTE")  # as in wanted_minutes
    start = values.minute(F.coalesce(F.try_to_timestamp(F.lit(cursor).cast("string"), F.lit(values.MINUTE_FORMAT)), lookback))
    failed = F.col("error").isNotNull()
    made = outcomes.agg(F.min(F.when(failed, F.col("minute"))).alias("stop"), F.min_by("error", F.when(failed, F.col("minute"))).alias("code"), F.max("minute").alias("last"))
    made = made.withColumns({"start": start, "ahead": start > moment})
    stop = F.when(F.col("stop") > F.col("start"), F.col("stop"))
    after = F.coalesce(F.col("last") + F.expr("INTERVAL 1 MINUTE"), "start")
    reached = F.when(F.col("ahead"), None).when(F.col("stop").isNotNull(), stop).otherwise(after)
    return made.select(F.date_format(reached, values.MINUTE_FORMAT).alias("cursor"), F.when(F.col("ahead"), "gdelt_cursor_ahead").otherwise(F.col("code")).alias("error_code"))


def too_new(minute: Column, server: Column, lag_minutes: int = 2) -> Column:
    """SRC-02: a missing minute that the server's clock has not reached yet is an error, not a gap."""
    return minute > server - F.expr(f"INTERVAL {lag_minutes} MINUTE") + F.expr("INTERVAL 1 MINUTE")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: file, value: the lines; those before the damage of a damaged file."""
    return spark.read.option("ignoreCorruptFiles", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"(\d{14})\.gqg\.json", 1).alias("file"), "value")


def articles(rows: DataFrame, languages: Iterable[str] | None, *, allow_unknown: bool = False) -> DataFrame:
    """SRC-04: the lines with json, lang, url, published_at and outcome: blank, malformed, language_skipped or accepted.

    languages: accepted ones in lower case, None for all.  The language is looked at before all else of an article.
    """
    made = rows.withColumn("json", F.when(F.expr("is_valid_utf8(value)") & (F.octet_length("value") <= LINE_BYTES), F.try_parse_json("value")))
    made = made.withColumn("is_object", F.coalesce(F.expr(_OBJECT), F.lit(False)))
    text = lambda name: F.when(F.expr(f"schema_of_variant(variant_get(json, '$.{name}'))") == "STRING", F.try_variant_get("json", f"$.{name}", "string"))
    made = made.withColumns({"lang": F.when(F.col("is_object"), text("lang")), "url": F.when(F.col("is_object"), text("url")), "date": F.when(F.col("is_object"), text("date"))})
    made = made.withColumn("lang", F.when(F.trim("lang") != "", F.col("lang")))
    made = made.withColumn("published_at", F.when(F.col("date").rlike(r"^\d{4}-?\d{2}-?\d{2}"), values.iso_time(F.col("date"))))
    made = made.withColumn("quotes", F.try_variant_get("json", "$.quotes", "array<variant>"))
    made = made.withColumn("is_list", F.coalesce(F.expr("schema_of_variant(variant_get(json, '$.quotes')) like 'ARRAY%'"), F.lit(False)))
    known = F.lit(True) if languages is None else F.lower(F.trim("lang")).isin(*languages)
    fits = F.when(F.col("lang").isNull(), F.lit(allow_unknown)).otherwise(known)
    good = F.col("url").isNotNull() & F.col("published_at").isNotNull() & F.col("is_list")
    outcome = (
        F.when(F.trim("value") == "", "blank").when(~F.col("is_object"), "malformed")
        .when(~fits, "language_skipped").when(~good, "malformed").otherwise("accepted")
    )
    return made.withColumn("outcome", outcome)


def quotes(found: DataFrame) -> DataFrame:
    """SRC-05: every quote of accepted articles with text and outcome: rejected, too_long or accepted."""
    each = found.where("outcome = 'accepted'").select("file", "lang", "url", "date", "published_at", "json", F.posexplode("quotes").alias("at", "quote"))
    inner = lambda name: F.when(F.expr(f"schema_of_variant(try_variant_get(quote, '$.{name}', 'variant'))") == "STRING", F.try_variant_get("quote", f"$.{name}", "string"))
    each = each.withColumns({"text": F.regexp_replace(inner("quote"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "pre": inner("pre"), "post": inner("post")})
    bad = F.col("text").isNull() | (F.col("text") == "") | ~F.col("url").rlike(r"^https?://[^/\s]+")
    return each.withColumn("outcome", F.when(bad, "rejected").when(F.length("text") > QUOTE_CHARS, "too_long").otherwise("accepted"))


def items(found: DataFrame) -> DataFrame:
    """Items of accepted quotes; the id is the start of a hash of URL and quote."""
    good = quotes(found).where("outcome = 'accepted'")
    context = lambda c: F.coalesce(F.substring(c, 1, CONTEXT_CHARS), F.lit(""))
    title = F.try_variant_get("json", "$.title", "string")
    payload = F.to_json(F.struct(context(title).alias("title"), context(F.col("pre")).alias("pre"), F.col("text").alias("quote"), context(F.col("post")).alias("post"), "url", "lang", "date", F.col("file").alias("gqg_file")))
    return good.select(
        F.lit("gdelt").alias("source"), F.substring(F.sha2(F.concat_ws("\n", "url", "text"), 256), 1, 32).alias("external_id"), "url",
        *(F.expr(EMPTY[c]).alias(c) for c in ("author_id", "author_handle", "author_display_name")),
        F.col("text").alias("original_text"), F.col("lang").alias("language"), "published_at",
        F.expr(EMPTY["engagement"]).alias("engagement"), payload.alias("raw_payload_json"), F.lit(SOURCE_KEY).alias("source_key"),
    )


def statistics(found: DataFrame) -> DataFrame:
    """AGG-09: metric, value of a scan, in one pass over the articles and one over their quotes."""
    a = found.agg(
        F.count_if("is_object").alias("articles_seen"), F.count_if(F.col("outcome") == "malformed").alias("malformed_rows"),
        F.count_if(F.col("outcome") == "language_skipped").alias("articles_language_skipped"),
        F.coalesce(F.sum(F.when(F.col("is_list"), F.size("quotes"))), F.lit(0)).alias("quotes_seen"),
    )
    q = quotes(found).agg(
        F.count_if(F.col("outcome") == "accepted").alias("quotes_accepted"), F.count_if(F.col("outcome") == "rejected").alias("quotes_rejected"),
        F.count_if(F.col("outcome") == "too_long").alias("quotes_too_long"),
    )
    long = lambda df: df.unpivot([], [F.col(c).cast("long").alias(c) for c in df.columns], "metric", "value")
    return long(a).union(long(q))
