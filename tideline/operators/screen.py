"""Screening: candidates and the first reason to filter one out (PRJ-01, FLT-01..07)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text, urls

MANUAL = "manual"


@dataclass(frozen=True)
class Policy:
    """What is filtered out; blocked authors are handles without @ and case, or raw ids."""

    max_age: timedelta = timedelta(hours=72)
    least_length: int = 20
    blocked_authors: Sequence[str] = ()
    blocked_terms: Sequence[str] = ()


def candidates(items: DataFrame) -> DataFrame:
    """PRJ-01: items with their canonical URL, comparison text and content hash; null texts have null hashes."""
    made = items.withColumn("normalized_text", text.comparison_text(F.col("original_text")))
    made = made.withColumn("content_hash", F.sha2("normalized_text", 256))
    return made.withColumn("url", urls.url_canonical(F.col("url")))


def is_valid(items: DataFrame) -> Column:
    """FLT-07: the bounds of an item, false for nulls in what an item needs."""
    need = F.length("external_id").between(1, 255) & (F.length("original_text") >= 1) & F.col("source").isNotNull()
    return F.coalesce(need & F.col("url").rlike(r"^https?://[^/\s]+") & F.col("published_at").isNotNull(), F.lit(False))


def first_reason(policy: Policy, now: datetime) -> Column:
    """FLT-01: too_old, blocked_author, too_short, blocked_term, the first that holds, else null.

    Of rows with source_key, published_at, author_handle, author_id, normalized_text; a null gives no reason.  Exactly
    max_age old is kept, and a manual item is never too old.
    """
    oldest = F.lit(now - policy.max_age).cast("timestamp_ntz")
    old = (F.coalesce("source_key", F.lit("")) != MANUAL) & (F.col("published_at").cast("timestamp_ntz") < oldest)
    reason = F.when(old, F.lit("too_old"))
    if policy.blocked_authors:
        keys = F.array_compact(F.array(text.case_folded("author_handle"), "author_id"))
        reason = reason.when(F.arrays_overlap(keys, F.array(*map(F.lit, policy.blocked_authors))), F.lit("blocked_author"))
    reason = reason.when(text.bare_length(F.col("normalized_text")) < policy.least_length, F.lit("too_short"))
    if policy.blocked_terms:
        terms = F.array(*map(F.lit, policy.blocked_terms))
        reason = reason.when(F.exists(terms, lambda t: F.contains(F.col("normalized_text"), t)), F.lit("blocked_term"))
    return reason
