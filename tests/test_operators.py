from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import text, urls, values
from tideline.operators import dedup, folds, score, screen

NOW = datetime(2026, 1, 2)


def test_first_reason_order_and_edges(spark):
    rows = [
        (1, "x:a", NOW - timedelta(hours=72), None, None, "long enough to be kept here"), (2, "x:a", NOW - timedelta(hours=72, seconds=1), None, None, "short"),
        (3, "manual", NOW - timedelta(days=99), None, None, "long enough to be kept here"), (4, "x:a", NOW, "BOB", "1", "short"),
        (5, "x:a", NOW, None, "u9", "long enough to be kept here"), (6, None, NOW, "eve", "1", "https://a.b/c @eve #été $x hi"),
        (7, "x:a", NOW, "eve", "1", "long enough but spam inside it"), (8, "x:a", None, None, None, None), (9, "x:a", NOW, None, None, ""),
        (10, "x:a", NOW, "Straße", None, "long enough to be kept here"),
    ]
    df = spark.createDataFrame(rows, "seq int, source_key string, published_at timestamp_ntz, author_handle string, author_id string, normalized_text string")
    policy = screen.Policy(blocked_authors=("bob", "u9", "strasse"), blocked_terms=("spam",))
    got = {r.seq: r.r for r in df.select("seq", screen.first_reason(policy, NOW).alias("r")).collect()}
    assert got == {1: None, 2: "too_old", 3: None, 4: "blocked_author", 5: "blocked_author", 6: "too_short", 7: "blocked_term", 8: None, 9: "too_short", 10: "blocked_author"}


def _greedy(rows):
    ids, seen, kept = set(), set(), []
    for seq, source, i, u in sorted(rows):
        shared = source == "gdelt"
        if (source, i) in ids or (not shared and u is not None and (source, u) in seen):
            continue
        ids.add((source, i))
        seen.add((source, u))
        kept.append(seq)
    return kept


def test_greedy_example_and_random(spark):
    example = [(0, "a", "i1", "u1"), (1, "a", "i2", "u1"), (2, "a", "i2", "u2"), (3, "a", "i1", "u3"), (4, "a", "i4", "u3")]
    rng = random.Random(3)
    noise = [(s, rng.choice(["a", "b", "gdelt"]), f"i{rng.randrange(40)}", rng.choice([None, *(f"u{k}" for k in range(40))])) for s in range(10, 400)]
    for rows in (example, noise, []):
        df = spark.createDataFrame(rows, "seq bigint, source string, external_id string, url string").withColumn("_k", F.lit(1))
        assert sorted(r.seq for r in dedup.greedy(df).collect()) == _greedy(rows)
    assert _greedy(example) == [0, 2, 4]


def test_first_by_and_links(spark):
    rows = [(1, "a", None, "h", "too_old"), (2, "b", "x", "h", None), (3, "c", "x", "g", None), (4, "d", "x", "g", None), (5, "e", None, None, None)]
    df = spark.createDataFrame(rows, "seq bigint, id string, k string, content_hash string, reason string")
    assert sorted(r.seq for r in dedup.first_by(df, ["k"]).collect()) == [1, 2, 5]
    assert {r.seq: r.duplicate_of for r in dedup.content_links(df).collect()} == {1: None, 2: "a", 3: None, 4: "c", 5: None}
    assert [r.seq for r in dedup.earlier_copies(df).select("seq").orderBy("seq").collect()] == [2, 4]


def test_folds(spark):
    log = spark.createDataFrame([(1, "k", True), (2, "k", False), (3, "k", True), (4, "k", True), (5, None, True)], "seq bigint, key string, bad boolean")
    got = {r.key: (r.failures, r.last_success, r.last_failure) for r in folds.streaks(log, "key", F.col("bad")).collect()}
    assert got == {"k": (2, 2, 4), None: (1, None, 5)}
    steps = spark.createDataFrame([(1, "e", ["NEW"], "SEEN"), (2, "e", ["SEEN"], "DONE"), (3, "e", ["SEEN"], "LOST")], "seq bigint, e string, expected array<string>, target string")
    assert folds.compare_and_set(steps, "e", "NEW").collect()[0].state == "DONE"
    costs = spark.createDataFrame([(i, "m", 300_000) for i in range(20)], "seq bigint, m string, cost bigint")
    assert sorted(r.seq for r in folds.accepted(costs, "m", "cost", 1_000_000).where("ok").collect()) == [0, 1, 2]


def test_scores(spark):
    rows = [("a", "He SAID so", 'he said "so"', '{"replies": 95}'), ("b", None, None, None), ("c", "a rumor", "a rumor", "not json")]
    df = spark.createDataFrame(rows, "id string, normalized_text string, original_text string, engagement_json string")
    got = {r.id: r.total for r in score.offline(df.withColumn("normalized_text", F.lower("normalized_text"))).collect()}
    assert got == {"a": 27 + 18 + 15 + 32, "b": 18 + 12 + 7 + 32, "c": 18 + 12 + 7 + 32 - 3}


def test_injected_scorer_isolates_poison(spark):
    df = spark.createDataFrame([(str(i), "poison" if i == 3 else "ok") for i in range(12)], "id string, original_text string").coalesce(1)

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["original_text"] == "poison").any():
            raise ValueError
        return pd.DataFrame({"id": pdf["id"], **{n: 99 if pdf["id"].iloc[0] == "10" else 5 for n in score.BOUNDS}})

    got = {r.id: (r.outcome, r.total) for r in score.injected(df, scorer).collect()}
    assert got["3"] == ("failed", None) and got["2"] == ("scored", 25) and got["10"] == ("invalid", None) and len(got) == 12


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://[2001:DB8::1]:8080/a/", "http://[2001:db8::1]:8080/a"), ("https://n.example/?utm%5Fsource=x&&id=1#top", "https://n.example?id=1"),
        ("https://www.twitter.com/a?REF=1&b=a+c", "https://x.com/a?b=a+c"), ("https://u:p@h.example/p//?q", "https://h.example/p?q"), ("not a url", "not a url"), (None, None),
    ],
)
def test_canonical_url(url, want):
    assert urls.canonical(url) == want


@given(st.text())
def test_text_forms_are_stable(s):
    assert text.normalized(text.normalized(s)) == text.normalized(s)
    assert not text.comparison(s).startswith(" ")


def test_text_functions(spark):
    rows = [("Straße\u001f ſ", "<p>A&amp;amp;B</p>", "“x y”"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = df.select(text.comparison_text("a"), text.html_plain("b"), text.quote_text("c"), text.quote_in_source(F.col("c"), F.lit('say "x y" now'))).collect()
    assert [tuple(r) for r in got] == [("strasse s", "A&B", '"x y"', True), (None, None, None, None), ("", "", "", False)]
    one = spark.range(1).select(
        text.first_quoted(F.lit('a "bc" "def"')), text.outer_object(F.lit('x {"a": {}} y')), text.html_escape(F.lit("<a & 'b'>")),
        text.template_fits(F.lit("go {url}")), text.present(F.lit(""), F.lit("b"), F.lit(None).cast("string")), text.bare_length(F.lit(" @a #b http://c d ")),
    ).collect()[0]
    assert tuple(one) == (None, '{"a": {}}', "&lt;a &amp; &#x27;b&#x27;&gt;", True, "b", 1)


def test_values(spark):
    one = spark.range(1).select(
        values.mail_time(F.lit("Wed, 02 Oct 2002 15:00:00 +0200")).cast("string"), values.mail_time(F.lit("nonsense")), values.snowflake_time(F.lit("x")),
        values.micros(F.lit("0.0000001").cast("decimal(18,7)")), values.clamp(F.lit(120), 0, 100), values.json_typed(F.lit('{"a": [1]}'), "$.a", "bigint"),
        values.label(F.lit("zz"), {"a": "A"}), values.merged_counters(F.create_map(F.lit("a"), F.lit(1).cast("long")), F.lit(None).cast("map<string,bigint>")),
    ).collect()[0]
    assert tuple(one) == ("2002-10-02 13:00:00", None, None, 0, 100, None, "zz", {"a": 1})


def test_public_addresses():
    assert urls.is_public(["8.8.8.8"]) and not urls.is_public(["8.8.8.8", "10.0.0.1"]) and not urls.is_public([]) and not urls.is_public(["x"])


def test_upkeep(spark):
    from tideline.operators import upkeep

    at = lambda s: F.lit(s).cast("timestamp")
    one = spark.range(1).select(
        upkeep.next_slot(at("2026-03-29 00:30:00"), ["02:30", "20:00"], "Europe/Berlin").cast("string"),  # 02:30 is skipped that night
        upkeep.next_slot(at("2026-01-01 19:00:00"), ["09:00", "20:00"], "Europe/Berlin").cast("string"), upkeep.next_slot(F.lit(None).cast("timestamp"), ["09:00"], "UTC"),
        upkeep.is_alive(at("2026-01-01 23:58:00"), NOW), upkeep.is_alive(F.lit(None).cast("timestamp"), NOW),
    ).collect()[0]
    assert tuple(one) == ("2026-03-29 01:30:00", "2026-01-02 08:00:00", None, True, False)
    assert upkeep.clock_times("18:00, 9:00,9:00") == ["09:00", "18:00"]
    with pytest.raises(ValueError):
        upkeep.clock_times("9:00")


def test_config():
    from tideline.config import Settings, SourceList

    made = SourceList.of({"accounts": ["@Ann", "bo"], "feeds": {"a": "u"}, "blocked_terms": ["Spam"]})
    assert made.accounts == ("ann", "bo") and made.blocked_terms == ("spam",)
    for bad in ({"accounts": ["a", "@A"]}, {"feeds": {"A b": "u"}}, {"feeds": {"a": "u", "b": "u"}}, {"other": 1}):
        with pytest.raises(ValueError):
            SourceList.of(bad)
    with pytest.raises(ValueError):
        Settings(lookback_minutes=100, most_minutes=5)
