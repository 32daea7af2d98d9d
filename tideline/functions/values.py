"""Times, numbers, JSON, maps and labels (DTE-F*, MTH-F*, JSN-F*, MAP-F1, LBL-F1).  Built-in expressions only.

Session time zone is UTC; "now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: milliseconds of the epoch that snowflake ids count from.
SNOWFLAKE_EPOCH = 1288834974657
MINUTE_FORMAT = "yyyyMMddHHmmss"


def iso_time(c: Column) -> Column:
    """DTE-F1: an ISO 8601 text as UTC time; one without zone means UTC, what is none is null."""
    return F.try_to_timestamp(c)


def mail_time(c: Column) -> Column:
    """DTE-F2: an RFC 822 date with or without weekday; null for any other text."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    bare = F.regexp_replace(bare, r"\b(?:GMT|UTC|UT|Z)$", "+0000")
    bare = F.regexp_replace(bare, r"^(\d) ", "0$1 ")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm Z")))


def snowflake_time(c: Column) -> Column:
    """DTE-F3: when a snowflake id was made; null for what is no number of at most 19 digits."""
    n = F.when(c.cast("string").rlike("^[0-9]{1,19}$"), F.try_to_number(c.cast("string"), F.lit("9" * 19)).cast("long"))
    return F.timestamp_millis(F.shiftright(n, 22) + F.lit(SNOWFLAKE_EPOCH))


def minute(c: Column) -> Column:
    """DTE-F4."""
    return F.date_trunc("minute", c)


def minutes(start: Column, end: Column) -> Column:
    """DTE-F4: every minute from start to end."""
    return F.sequence(minute(start), minute(end), F.expr("INTERVAL 1 MINUTE"))


def month(c: Column) -> Column:
    """DTE-F5."""
    return F.date_trunc("month", c)


def local_day(c: Column, zone: str) -> Column:
    """DTE-F6: start of the zone's day, in UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(c, zone)), zone)


def age_minutes(c: Column, now: Column) -> Column:
    """DTE-F7 and PRJ-05: whole minutes, none negative."""
    return F.greatest(F.lit(0), F.expr("0") + F.timestamp_diff("MINUTE", c, now)).cast("long")


def local_text(c: Column, zone: str, pattern: str = "dd.MM HH:mm") -> Column:
    """DTE-F8."""
    return F.date_format(F.from_utc_timestamp(c, zone), pattern)


def clamp(c: Column, low: int, high: int) -> Column:
    """MTH-F1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def micros(usd: Column) -> Column:
    """MTH-F2: millionths of a decimal amount, rounded up."""
    return F.ceil(usd.cast("decimal(18,6)") * 1_000_000).cast("long")


def json_text(c: Column, path: str) -> Column:
    """JSN-F2."""
    return F.get_json_object(c, path)


def json_typed(c: Column, path: str, kind: str) -> Column:
    """JSN-F3: the value at path if it has that type, else null; so for JSON that cannot be read."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def counters(c: Column, names: list[str]) -> Column:
    """AGG-07: the named counters of a JSON object as a map; missing ones are 0."""
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(json_typed(c, f"$.{n}", "bigint"), F.lit(0).cast("bigint")))]
    return F.create_map(*pairs)


def merged_counters(a: Column, b: Column) -> Column:
    """MAP-F1: sums by name of two maps, null maps being empty."""
    empty = F.from_json(F.lit("{}"), "map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def label(c: Column, labels: dict[str, str]) -> Column:
    """LBL-F1: the label of a code, or the code."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)
