from __future__ import annotations

import gzip
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tideline.operators import screen
from tideline.sources import feeds, posts, quotes, registry
from tideline.streaming import ingest

NOW = datetime(2026, 1, 1, 12, tzinfo=UTC)


def _article(**more):
    base = {"date": "2026-01-01T10:00:00", "url": "https://n.example/a", "title": "T", "lang": "English", "quotes": [{"pre": "p", "quote": " A quote ", "post": "q"}, {"quote": " "}, {"quote": 5}, "x", {"quote": "z" * 2001}]}
    return json.dumps(base | more)


def test_quote_files(spark, tmp_path):
    lines = [_article(), _article(lang="German"), _article(lang=None), _article(date="never"), _article(url=7), _article(quotes={}), "[1]", "{broken", "", _article(quotes=[])]
    (tmp_path / "20260101100000.gqg.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    found = quotes.articles(quotes.lines(spark, str(tmp_path)), ["english"])
    stats = {r.metric: r.value for r in quotes.statistics(found).collect()}
    assert stats == {"articles_seen": 7, "malformed_rows": 5, "articles_language_skipped": 2, "quotes_seen": 25, "quotes_accepted": 1, "quotes_rejected": 3, "quotes_too_long": 1}
    item = quotes.items(found).collect()
    assert len(item) == 1 and item[0].original_text == "A quote" and len(item[0].external_id) == 32 and json.loads(item[0].raw_payload_json)["gqg_file"] == "20260101100000"


def test_minutes(spark):
    now = datetime(2026, 1, 1, 12, 0, 30)
    assert [r.file for r in quotes.wanted_minutes(spark, "20260101115700", now).collect()] == [f"2026010111{m}00.gqg.json.gz" for m in (57, 58)]
    assert quotes.wanted_minutes(spark, "bad", now, lookback_minutes=5).count() == 6
    assert quotes.wanted_minutes(spark, "20270101000000", now).count() == 0
    assert quotes.wanted_minutes(spark, "20250101000000", now, most=7).count() == 7


RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><language>en</language>
<item><title>One &amp;amp; two</title><link>/a?utm_source=x</link><description><![CDATA[<b>Hi</b> there]]></description><dc:creator>Ann</dc:creator><pubDate>Wed, 31 Dec 2025 15:00:00 +0200</pubDate></item>
<item><title>No link</title></item><item><guid>http://g.example/1</guid><title>Guid</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="de"><entry><id>e1</id><link rel="self" href="/self"/><link href="/real"/><title type="html">&lt;i&gt;T&lt;/i&gt;</title><author><name>Bo</name></author><updated>2025-12-31T00:00:00Z</updated></entry></feed>"""
BOMB = '<!DOCTYPE r [<!ENTITY a "b">]><rss><channel/></rss>'


def test_feeds(spark):
    docs = [("r", "https://f.example/rss", RSS.encode()), ("a", "https://f.example/atom", ATOM.encode()), ("b", "u", BOMB.encode("utf-16")), ("h", "u", b"<html/>"), ("n", "u", None)]
    parsed = feeds.read(spark.createDataFrame(docs, "name string, url string, body binary"), NOW)
    assert sorted(r.name for r in parsed.where("error_code IS NOT NULL").collect()) == ["b", "h", "n"]
    assert {r.name: (r.entries_seen, r.entries_rejected) for r in parsed.where("entries_seen > 0").collect()} == {"r": (3, 1), "a": (1, 0)}
    got = {r.external_id: r for r in feeds.items(parsed).collect()}
    one = got["r:https://f.example/a"]
    assert one.original_text == "One & two\n\nHi there" and one.author_display_name == "Ann" and one.language == "en" and one.published_at == datetime(2025, 12, 31, 13)
    assert got["r:http://g.example/1"].published_at == NOW.replace(tzinfo=None) and got["a:e1"].url == "https://f.example/real" and got["a:e1"].language == "de"


def test_feed_identity_and_damage(spark):
    long = "g" * 300
    body = f"<rss><channel><item><guid>{long}</guid><link>https://a.example/x</link><title>T</title><author>Al <b>Bo</b></author></item><item><link>ftp://a.example/x</link><title>T</title></item><item><link>https://a.example/y</link></item></channel></rss>"
    docs = [("l", "https://f.example/", body.encode()), ("l", "https://f.example/", b"<rss><channel></channel></rss>"), ("d", None, b"<rss><item></rss>")]
    parsed = feeds.read(spark.createDataFrame(docs, "name string, url string, body binary"), NOW).collect()
    counts = sorted((r.name, r.error_code or "", r.entries_seen, r.entries_rejected) for r in parsed if r.entries_seen is not None)
    assert counts == [("d", "malformed_feed", 0, 0), ("l", "", 0, 0), ("l", "", 3, 2)]
    (item,) = [r for r in parsed if r.external_id]
    assert item.external_id.startswith("l:sha256:") and len(item.external_id) == 73 and item.author_display_name == "Al Bo"


def test_posts(spark, tmp_path):
    page = {"data": [{"id": "10", "text": "a &amp; b", "author_id": "u", "created_at": "2026-01-01T00:00:00Z", "public_metrics": {"like_count": 3, "repost_count": 2}}, {"id": "9", "text": "x"}, "junk", {"id": "11", "text": "s", "note_tweet": {"text": "long"}, "created_at": "2026-01-01T00:00:00Z"}], "includes": {"users": [{"id": "u", "username": "ann", "name": "Ann"}]}}
    (tmp_path / "1.json").write_text(json.dumps(page))
    found = posts.pages(spark, str(tmp_path))
    got = {r.external_id: r for r in posts.items(found, "query:q").collect()}
    assert set(got) == {"10", "11"} and got["10"].original_text == "a & b" and got["10"].url == "https://x.com/ann/status/10"
    assert got["10"].engagement.asDict() == {"likes": 3, "reposts": 2, "replies": 0, "quotes": 0, "views": None} and got["11"].original_text == "long"
    assert posts.newest_id(found).collect()[0].newest_id == "11"
    assert posts.since("1", NOW, spark).collect()[0].since_id is None


def test_registry(spark):
    def broken(_):
        raise OSError

    def failing(s):  # when run
        return registry.memory(s, [row]).withColumn("url", F.raise_error(F.lit("down")).cast("string"))

    row = {"source": "x", "external_id": "1", "url": "https://a.example/", "original_text": "t"}
    items, errors = registry.collect(spark, [registry.Source("m", lambda s: registry.memory(s, [row])), registry.Source("b", broken), registry.Source("late", failing), registry.Source("off", broken, enabled=False)])
    assert items.count() == 1 and set(errors) == {"b", "late"} and errors["b"] == "OSError"


@pytest.mark.parametrize("split", [1, 3])
def test_ingest_stream_is_idempotent(spark, tmp_path, split):
    schema = "seq bigint, source string, external_id string, url string, author_id string, author_handle string, original_text string, published_at timestamp, source_key string"
    text = "a text that is long enough to be kept"
    rows = [
        (1, "rss", "1", "https://a.example/1", None, None, text, NOW, "k"), (2, "rss", "1", "https://a.example/2", None, None, text, NOW, "k"),
        (3, "rss", "3", "https://a.example/1?utm_source=f", None, None, text, NOW, "k"), (4, "x", "4", "https://a.example/1", None, None, text.upper(), NOW, "k"),
        (5, "x", "5", "https://a.example/5", None, None, "short", NOW, "k"), (6, "x", None, "https://a.example/6", None, None, text, NOW, None),
    ]
    for i in range(split):
        part = [r for k, r in enumerate(rows) if k * split // len(rows) == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = ingest.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.start(stream, store, screen.Policy(), lambda: NOW.replace(tzinfo=None), str(tmp_path / "at")).awaitTermination()
    events = {r.seq: (r.reason, r.duplicate_of is not None) for r in store.read("events", ingest.EVENTS).collect()}
    assert events == {1: (None, False), 4: ("duplicate_content", True), 5: ("too_short", False)}
    sums = {(r.source_key, r.metric): r.v for r in store.read("metrics", ingest.METRICS).groupBy("source_key", "metric").agg({"value": "sum"}).withColumnRenamed("sum(value)", "v").collect()}
    assert sums[("k", "collected")] == 5 and sums[("k", "inserted")] == 3 and sums[("k", "filtered")] == 1 and sums[("k", "exact_duplicates")] == 3
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    ingest.cycle(store, screen.Policy(), lambda: NOW.replace(tzinfo=None))(batch, 99)  # all known by now
    assert store.read("events", ingest.EVENTS).count() == 3


def test_progress_stops_before_the_failing_minute(spark):
    now = datetime(2026, 5, 1, 12, 0, 30, tzinfo=UTC)

    def run(cursor, *errors):
        rows = [(datetime(2026, 5, 1, 11, 50 + i, tzinfo=UTC), e) for i, e in enumerate(errors)]
        return tuple(quotes.progress(spark.createDataFrame(rows, "minute timestamp, error string"), cursor, now).first())

    at = "20260501115000"
    assert run(at, None, None, "gdelt_http_500", None, "gdelt_http_503") == ("20260501115200", "gdelt_http_500")
    assert run(at, "gdelt_timeout", None) == (None, "gdelt_timeout")
    assert run(at, None, None) == ("20260501115200", None) and run(at) == (at, None)
    assert run("20260501120100") == (None, "gdelt_cursor_ahead") and run("20260501120000") == ("20260501120000", None)
    assert run("no time") == ("20260501105800", None)
