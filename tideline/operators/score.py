"""Scores: bounded components, clamped totals, the offline scorer, checked answers of an injected one (AGG-11, UDF-02..05, FLT-14)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text, values

# The components, their upper bounds, and the words and points of the offline scorer.
BOUNDS = {"qmemo_relevance": 30, "quote_strength": 20, "discussion_potential": 15, "freshness": 15, "clarity": 10, "action_likelihood": 10, "risk_penalty": 30}
_WORDS, _RUMOR = ("quote", "prediction", "said"), "rumor"


def total() -> Column:
    """AGG-11: the components less the penalty, from 0 to 100."""
    gain = sum((F.col(c) for c in BOUNDS if c != "risk_penalty"), F.lit(0))
    return values.clamp(gain - F.col("risk_penalty"), 0, 100)


def in_bounds() -> Column:
    """FLT-14: every component within its bounds."""
    fits = F.lit(True)
    for name, high in BOUNDS.items():
        fits = fits & F.coalesce(F.col(name).between(0, high), F.lit(False))
    return fits


def offline(events: DataFrame) -> DataFrame:
    """UDF-03: events (normalized_text, original_text, engagement_json) with components, total, headline and summary.

    A null text has none of the words; missing replies are 0.
    """
    has = [F.contains(F.col("normalized_text"), F.lit(w)) for w in _WORDS]
    replies = F.coalesce(values.json_typed(F.col("engagement_json"), "$.replies", "bigint"), F.lit(0))
    points = {
        "qmemo_relevance": F.when(has[0] | has[1] | has[2], 27).otherwise(18),
        "quote_strength": F.when(F.contains(F.col("original_text"), F.lit('"')), 18).otherwise(12),
        "discussion_potential": F.least(F.lit(15), F.lit(7) + F.floor(replies / 10)).cast("int"),
        "freshness": F.lit(15), "clarity": F.lit(9), "action_likelihood": F.lit(8),
        "risk_penalty": F.when(F.contains(F.col("normalized_text"), F.lit(_RUMOR)), 3).otherwise(0),
        "headline": text.clip(F.col("original_text"), 80), "summary": text.clip(F.col("original_text"), 280),
    }
    return events.withColumns(points).withColumn("total", total())


def injected(events: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 10) -> DataFrame:
    """UDF-02, UDF-04, UDF-05: scores of an injected scorer: id, components, total, outcome.

    The scorer gets batches of rows (id, original_text) and returns id and the components.  An answer whose ids are not
    those of its batch, or an exception, sends the batch row by row; a row that fails alone has outcome "failed" and
    null components, one out of bounds "invalid".  The total is always made here.
    """
    names = list(BOUNDS)

    def ask(pdf: pd.DataFrame) -> pd.DataFrame | None:
        try:
            got = scorer(pdf)
            ok = len(got) == len(pdf) and set(got["id"]) == set(pdf["id"])
            return got[["id", *names]].assign(outcome="scored") if ok else None
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                if (got := ask(part)) is None:
                    rows = [ask(part.iloc[i : i + 1]) for i in range(len(part))]
                    empty = pd.DataFrame({"id": part["id"], **dict.fromkeys(names), "outcome": "failed"})
                    got = pd.concat([empty.iloc[i : i + 1] if r is None else r for i, r in enumerate(rows)])
                yield got.astype(dict.fromkeys(names, "Int32"))

    schema = "id string, " + ", ".join(f"{n} int" for n in names) + ", outcome string"
    made = events.select("id", "original_text").mapInPandas(run, schema)
    bad = (F.col("outcome") == "scored") & ~in_bounds()
    return made.withColumn("outcome", F.when(bad, "invalid").otherwise(F.col("outcome"))).withColumn("total", F.when(F.col("outcome") == "scored", total()))
