"""Queries of the ingestion path and its read models over the domain tables, each with its SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text, urls, values
from tideline.operators import dedup, folds, read_models, score, screen, upkeep
from tideline.session import table

NOW = datetime(2026, 3, 3)
SINCE = datetime(2026, 3, 2)
POLICY = screen.Policy(timedelta(hours=24), 150, ("notes_600231", "u1000170"), ("quiet majority", "schweigenden mehrheit"))
COUNTERS = ["collected", "inserted", "filtered", "source_errors"]
ZONE = "Asia/Ho_Chi_Minh"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):  # noqa: ANN202
    def add(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REASON = r"""
  CASE WHEN coalesce(source_key, '') <> 'manual' AND published_at < TIMESTAMP '2026-03-02 00:00:00' THEN 'too_old'
       WHEN lower(author_handle) IN ('notes_600231', 'u1000170') OR author_id IN ('notes_600231', 'u1000170') THEN 'blocked_author'
       WHEN length(regexp_replace(regexp_replace(normalized_text, 'https?://[^\s\x1c-\x1f\x85\p{Z}]+|[@#$][\p{L}\p{N}_]+', '', 'g'), '^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$', '', 'g')) < 150 THEN 'too_short'
       WHEN contains(normalized_text, 'quiet majority') OR contains(normalized_text, 'schweigenden mehrheit') THEN 'blocked_term'
  END"""


@_query(f"SELECT coalesce(r, 'none') AS reason, count(*) AS n FROM (SELECT {_REASON} AS r FROM radar_events) GROUP BY 1")
def flt_first_reason(t) -> DataFrame:  # noqa: ANN001
    """FLT-01..05."""
    reason = F.coalesce(screen.first_reason(POLICY, NOW), F.lit("none")).alias("reason")
    return t("radar_events").select(reason).groupBy("reason").agg(F.count("*").alias("n"))


@_query(f"SELECT seq, {_REASON} AS reason FROM radar_events WHERE {_REASON} IS NOT NULL")
def flt_screened(t) -> DataFrame:  # noqa: ANN001
    return t("radar_events").select("seq", screen.first_reason(POLICY, NOW).alias("reason")).where("reason IS NOT NULL")


@_query("SELECT status, count(*) AS n FROM radar_events GROUP BY status")
def agg_status_counts(t) -> DataFrame:  # noqa: ANN001
    """AGG-01."""
    return read_models.counts(t("radar_events"), "status")


@_query("SELECT action, count(*) AS n FROM feedback GROUP BY action")
def agg_action_counts(t) -> DataFrame:  # noqa: ANN001
    """AGG-12."""
    return read_models.counts(t("feedback"), "action")


@_query("SELECT status, count(*) AS n FROM pipeline_runs GROUP BY status")
def agg_run_status(t) -> DataFrame:  # noqa: ANN001
    """AGG-12."""
    return read_models.counts(t("pipeline_runs"), "status")


@_query("""SELECT round(100.0 * (SELECT count(DISTINCT event_id) FROM feedback WHERE action = 'USE')
  / nullif(count(DISTINCT event_id), 0), 1)::DOUBLE AS use_rate_percent FROM telegram_deliveries""")
def agg_use_rate(t) -> DataFrame:  # noqa: ANN001
    """AGG-13."""
    return read_models.use_rate(t("telegram_deliveries"), t("feedback"))


@_query("""SELECT (s.total // 10 * 10)::BIGINT AS bucket, count(*) AS n FROM telegram_deliveries d
  JOIN event_scores s ON s.event_id = d.event_id GROUP BY 1""")
def agg_score_hist(t) -> DataFrame:  # noqa: ANN001
    """AGG-14, JON-12."""
    return read_models.score_histogram(t("telegram_deliveries"), t("event_scores"))


@_query("""SELECT e.source_key, count(DISTINCT d.event_id) AS cards, count(DISTINCT o.event_id) AS approved
  FROM radar_events e LEFT JOIN telegram_deliveries d ON d.event_id = e.id
  LEFT JOIN publication_outbox o ON o.event_id = e.id GROUP BY e.source_key""")
def agg_source_quality(t) -> DataFrame:  # noqa: ANN001
    """AGG-15, JON-11."""
    return read_models.source_quality(t("radar_events"), t("telegram_deliveries"), t("publication_outbox"))


@_query("""SELECT e.source_key, count(DISTINCT d.event_id) AS cards, count(DISTINCT o.event_id) AS approved
  FROM radar_events e LEFT JOIN telegram_deliveries d ON d.event_id = e.id
  LEFT JOIN publication_outbox o ON o.event_id = e.id GROUP BY e.source_key ORDER BY approved DESC, cards DESC, e.source_key NULLS FIRST LIMIT 20""")
def srt_source_quality(t) -> DataFrame:  # noqa: ANN001
    """SRT-11."""
    made = read_models.source_quality(t("radar_events"), t("telegram_deliveries"), t("publication_outbox"))
    return read_models.top(made, 20, F.desc("approved"), F.desc("cards"), F.col("source_key"))


@_query("""SELECT count(id) - count(DISTINCT id) AS id_repeats, count(url) - count(DISTINCT url) AS url_repeats,
  count(content_hash) - count(DISTINCT content_hash) AS content_hash_repeats FROM radar_events""")
def agg_dup_audit(t) -> DataFrame:  # noqa: ANN001
    """AGG-16."""
    return read_models.duplicate_audit(t("radar_events"), "id", "url", "content_hash")


@_query("""SELECT e.status, count(*) AS n FROM radar_events e
  WHERE e.status IN ('FILTERED_OUT', 'ARCHIVED') AND e.discovered_at < TIMESTAMP '2026-03-02'
    AND NOT EXISTS (SELECT 1 FROM telegram_deliveries d WHERE d.event_id = e.id)
    AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.event_id = e.id)
    AND NOT EXISTS (SELECT 1 FROM publication_outbox o WHERE o.event_id = e.id)
    AND NOT EXISTS (SELECT 1 FROM radar_events c WHERE c.duplicate_of_event_id = e.id)
  GROUP BY e.status""")
def agg_retention(t) -> DataFrame:  # noqa: ANN001
    """AGG-03, JON-03, STM-15."""
    return read_models.prunable(t("radar_events"), SINCE, [t("telegram_deliveries"), t("feedback"), t("publication_outbox")])


@_query("SELECT count(*) AS deliveries, count(DISTINCT event_id) AS events FROM telegram_deliveries WHERE delivered_at >= TIMESTAMP '2026-03-02'")
def agg_deliveries_since(t) -> DataFrame:  # noqa: ANN001
    """AGG-04, FLT-09."""
    rows = t("telegram_deliveries").where(F.col("delivered_at") >= read_models.at(SINCE))
    return rows.agg(F.count("*").alias("deliveries"), F.count_distinct("event_id").alias("events"))


@_query("""SELECT metric, sum(value)::BIGINT AS total FROM (
  SELECT unnest(['collected', 'inserted', 'filtered', 'source_errors']) AS metric,
    unnest([coalesce(json_extract_string(counters_json, '$.' || x)::BIGINT, 0) FOR x IN ['collected', 'inserted', 'filtered', 'source_errors']]) AS value
  FROM pipeline_runs WHERE started_at >= TIMESTAMP '2026-03-02') GROUP BY metric""")
def agg_run_totals(t) -> DataFrame:  # noqa: ANN001
    """AGG-07, MAP-F1."""
    return read_models.counter_totals(t("pipeline_runs"), COUNTERS, SINCE)


@_query("""SELECT source_key, count(*) AS collected, count(*) FILTER (filter_reason = 'duplicate_content') AS duplicates,
  count(*) FILTER (filter_reason <> 'duplicate_content') AS filtered, count(*) FILTER (filter_reason IS NULL) AS kept
  FROM radar_events GROUP BY source_key""")
def agg_source_counters(t) -> DataFrame:  # noqa: ANN001
    """AGG-08."""
    return read_models.source_counters(t("radar_events"))


@_query("""SELECT source_key, coalesce(filter_reason, 'kept') AS metric, count(*)::BIGINT AS value FROM radar_events GROUP BY 1, 2""")
def agg_metrics(t) -> DataFrame:  # noqa: ANN001
    """AGG-02, SNK-02: the deltas of each run, added up."""
    each = t("radar_events").groupBy("run_id", "source_key", F.coalesce("filter_reason", F.lit("kept")).alias("metric")).agg(F.count("*").alias("value"))
    return read_models.metric_deltas(each)


@_query("SELECT content_hash, id AS owner, seq AS owner_seq FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS k FROM radar_events WHERE content_hash IS NOT NULL) WHERE k = 1")
def agg_owners(t) -> DataFrame:  # noqa: ANN001
    """AGG-05, AGG-10, JON-07."""
    return dedup.owners(t("radar_events"))


@_query("SELECT e.id, e.seq, e.source_key, s.total, s.headline FROM radar_events e JOIN event_scores s ON e.id = s.event_id")
def jon_scored(t) -> DataFrame:  # noqa: ANN001
    """JON-01."""
    return read_models.scored(t("radar_events"), t("event_scores")).select("id", "seq", "source_key", "total", "headline")


@_query("""SELECT o.id AS package, e.id, e.status, o.status AS package_status FROM publication_outbox o JOIN radar_events e ON o.event_id = e.id
  WHERE o.status IN ('APPROVED', 'VERIFY_REQUIRED') AND e.status IN ('APPROVED', 'DRAFTED')""")
def jon_packages(t) -> DataFrame:  # noqa: ANN001
    """JON-02."""
    o = t("publication_outbox").where("status IN ('APPROVED', 'VERIFY_REQUIRED')").select(F.col("id").alias("package"), F.col("event_id").alias("id"), F.col("status").alias("package_status"))
    return o.join(t("radar_events").where("status IN ('APPROVED', 'DRAFTED')").select("id", "status"), "id").select("package", "id", "status", "package_status")


@_query("SELECT id, seq FROM radar_events WHERE id IN (SELECT event_id FROM telegram_deliveries WHERE delivered_at >= TIMESTAMP '2026-03-02')")
def jon_delivered_since(t) -> DataFrame:  # noqa: ANN001
    """JON-04."""
    return read_models.delivered_since(t("radar_events"), t("telegram_deliveries"), SINCE).select("id", "seq")


_STORED = "discovered_at < TIMESTAMP '2026-03-01 12:00:00'"


@_query(f"""SELECT seq FROM radar_events b WHERE NOT ({_STORED})
  AND NOT EXISTS (SELECT 1 FROM radar_events s WHERE s.{_STORED} AND s.source = b.source AND s.external_id = b.external_id)
  AND NOT EXISTS (SELECT 1 FROM radar_events s WHERE s.{_STORED} AND s.source = b.source AND s.url = b.url AND s.source <> 'gdelt')""")
def jon_unknown(t) -> DataFrame:  # noqa: ANN001
    """JON-05, JON-06, SNK-01: rows of a batch whose keys are not stored."""
    stored = F.col("discovered_at") < F.lit(datetime(2026, 3, 1, 12)).cast("timestamp_ntz")
    rows = t("radar_events").select("seq", "source", "external_id", "url", "discovered_at")
    return dedup.unknown(rows.where(~stored), rows.where(stored)).select("seq")


@_query("SELECT seq FROM radar_events e WHERE EXISTS (SELECT 1 FROM radar_events o WHERE o.content_hash = e.content_hash AND o.seq < e.seq)")
def jon_earlier_copy(t) -> DataFrame:  # noqa: ANN001
    """JON-08."""
    return dedup.earlier_copies(t("radar_events").select("seq", "content_hash")).select("seq")


@_query("SELECT e.seq, o.id AS link FROM radar_events e LEFT JOIN radar_events o ON o.id = e.duplicate_of_event_id WHERE e.filter_reason IS NOT NULL")
def jon_links(t) -> DataFrame:  # noqa: ANN001
    """JON-09."""
    return read_models.linked(t("radar_events").select("seq", "id", "duplicate_of_event_id", "filter_reason")).where("filter_reason IS NOT NULL").select("seq", "link")


@_query("SELECT event_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY updated_at DESC, id) AS k FROM publication_outbox) WHERE k = 1")
def win_latest(t) -> DataFrame:  # noqa: ANN001
    """WIN-02, SNK-04."""
    return read_models.latest(t("publication_outbox"), "event_id", F.desc("updated_at"), F.col("id")).select("event_id", "id", "status")


@_query("SELECT DISTINCT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY id) AS number FROM (SELECT DISTINCT * FROM telegram_deliveries)")
def win_delivery_no(t) -> DataFrame:  # noqa: ANN001
    """WIN-03."""
    return read_models.numbered(t("telegram_deliveries").distinct(), "event_id", "id").select("event_id", "id", F.col("number").cast("long").alias("number"))


@_query("SELECT id, seq, discovered_at FROM radar_events WHERE status = 'DISCOVERED' ORDER BY discovered_at DESC, seq DESC LIMIT 100")
def srt_newest(t) -> DataFrame:  # noqa: ANN001
    """SRT-01, STM-10."""
    return read_models.top(t("radar_events").where("status = 'DISCOVERED'").select("id", "seq", "discovered_at"), 100, F.desc("discovered_at"), F.desc("seq"))


@_query("""SELECT e.id, s.total FROM radar_events e JOIN event_scores s ON s.event_id = e.id
  WHERE e.status IN ('SHORTLISTED', 'SNOOZED') AND (s.total >= 60 OR e.source_key = 'manual')
  ORDER BY s.total DESC, e.published_at DESC, e.id LIMIT 50""")
def srt_deliverable(t) -> DataFrame:  # noqa: ANN001
    """SRT-02, FLT-08, FLT-10."""
    return read_models.deliverable(t("radar_events"), t("event_scores"), ("SHORTLISTED", "SNOOZED"), 60, 50).select("id", "total")


@_query("""SELECT e.id, s.total FROM radar_events e JOIN event_scores s ON s.event_id = e.id
  WHERE e.id IN (SELECT event_id FROM telegram_deliveries WHERE delivered_at >= TIMESTAMP '2026-03-02') ORDER BY s.total DESC, e.id LIMIT 20""")
def srt_delivered(t) -> DataFrame:  # noqa: ANN001
    """SRT-03."""
    rows = read_models.delivered_since(t("radar_events"), t("telegram_deliveries"), SINCE)
    return read_models.top(read_models.scored(rows, t("event_scores")), 20, F.desc("total"), F.col("id")).select("id", "total")


@_query("""SELECT e.id, s.total, e.updated_at FROM radar_events e JOIN event_scores s ON s.event_id = e.id
  WHERE e.status = 'SNOOZED' ORDER BY e.updated_at DESC, e.id LIMIT 20""")
def srt_by_status(t) -> DataFrame:  # noqa: ANN001
    """SRT-04."""
    rows = read_models.scored(t("radar_events").where("status = 'SNOOZED'"), t("event_scores"))
    return read_models.top(rows, 20, F.desc("updated_at"), F.col("id")).select("id", "total", "updated_at")


@_query("SELECT id, status, started_at FROM pipeline_runs ORDER BY started_at DESC, id LIMIT 10")
def srt_runs(t) -> DataFrame:  # noqa: ANN001
    """SRT-06."""
    return read_models.top(t("pipeline_runs").select("id", "status", "started_at"), 10, F.desc("started_at"), F.col("id"))


@_query("""SELECT seq, source, substr(original_text, 1, 500) AS text, json_extract_string(raw_payload_json, '$.title') AS title
  FROM radar_events ORDER BY seq DESC LIMIT 100""")
def srt_sample(t) -> DataFrame:  # noqa: ANN001
    """SRT-07, PRJ-03, SRC-23."""
    rows = read_models.top(t("radar_events").select("seq", "source", "original_text", "raw_payload_json"), 100, F.desc("seq"))
    return rows.select("seq", "source", text.clip(F.col("original_text"), 500).alias("text"), values.json_text(F.col("raw_payload_json"), "$.title").alias("title"))


@_query("SELECT id, (row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1) // 10 AS batch FROM radar_events")
def srt_batches(t) -> DataFrame:  # noqa: ANN001
    """SRT-09: batches of ten within each run, so that no window spans the table."""
    rows = read_models.numbered(t("radar_events").select("id", "run_id", "seq"), "run_id", "seq")
    return rows.select("id", F.expr("CAST((number - 1) div 10 AS BIGINT)").alias("batch"))


@_query("SELECT seq FROM (SELECT seq, source, external_id, row_number() OVER (PARTITION BY source, external_id ORDER BY seq) AS k FROM radar_events) WHERE k = 1 OR source IS NULL OR external_id IS NULL")
def set_id_dedup(t) -> DataFrame:  # noqa: ANN001
    """SET-02, WIN-01."""
    return dedup.first_by(t("radar_events").select("seq", "source", "external_id"), ["source", "external_id"]).select("seq")


@_query(None)
def set_greedy_dedup(t) -> DataFrame:  # noqa: ANN001
    """SET-02, SET-03 over canonical URLs: an ordered fold, held against brute force in the tests."""
    rows = t("radar_events").select("seq", "source", "external_id", urls.url_canonical(F.col("url")).alias("url"))
    return dedup.greedy(rows).select("seq")


@_query("""SELECT seq, CASE WHEN reason IS NULL AND owner_seq < seq THEN owner END AS duplicate_of FROM (
  SELECT seq, CASE WHEN filter_reason <> 'duplicate_content' THEN filter_reason END AS reason,
    first_value(id) OVER w AS owner, first_value(seq) OVER w AS owner_seq
  FROM radar_events WHERE content_hash IS NOT NULL WINDOW w AS (PARTITION BY content_hash ORDER BY seq)) WHERE reason IS NULL AND owner_seq < seq""")
def set_content_dedup(t) -> DataFrame:  # noqa: ANN001
    """SET-04."""
    rows = t("radar_events").select("seq", "id", "content_hash", F.expr("CASE WHEN filter_reason <> 'duplicate_content' THEN filter_reason END").alias("reason"))
    return dedup.content_links(rows).where("duplicate_of IS NOT NULL").select("seq", "duplicate_of")


@_query(r"""SELECT seq, regexp_replace(regexp_replace(base, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END, '^(https?://)(www\.)?twitter\.com(/|$|\?)', '\1x.com\3') AS url FROM (
  SELECT seq, lower(regexp_extract(u, '^[^:]+://[^/?]*')) || regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1) AS base,
    array_to_string(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(
      lower(url_decode(replace(string_split(p, '=')[1], '+', ' '))), '^(fbclid|gclid|ref|source|utm_(campaign|content|medium|source|term))$')), '&') AS q
  FROM (SELECT seq, regexp_replace(url, '#.*$', '') AS u FROM radar_events WHERE url IS NOT NULL))""")
def url_canonical(t) -> DataFrame:  # noqa: ANN001
    """URL-F1."""
    return t("radar_events").where("url IS NOT NULL").select("seq", urls.url_canonical(F.col("url")).alias("url"))


@_query(None)
def str_comparison(t) -> DataFrame:  # noqa: ANN001
    """STR-F1, STR-F2, PRJ-01: no SQL form of NFKC with case folding; held against Python in the tests."""
    made = screen.candidates(t("radar_events").select("seq", "original_text", "url"))
    return made.select("seq", "normalized_text", "content_hash")


@_query("SELECT seq, sha256(normalized_text) AS hash, substr(sha256(url || chr(10) || original_text), 1, 32) AS quote_id FROM radar_events")
def str_sha(t) -> DataFrame:  # noqa: ANN001
    """STR-F9."""
    return t("radar_events").select("seq", F.sha2("normalized_text", 256).alias("hash"), text.digest(F.col("url"), F.col("original_text"), length=32).alias("quote_id"))


@_query("""SELECT seq, CASE WHEN length(q) > 2 THEN q END AS quote FROM (SELECT seq, regexp_extract(original_text, '"([^"]*)"', 1) AS q FROM radar_events)""")
def str_first_quote(t) -> DataFrame:  # noqa: ANN001
    """STR-F7."""
    return t("radar_events").select("seq", text.first_quoted(F.col("original_text")).alias("quote"))


@_query("""SELECT event_id, replace(replace(replace(replace(replace(headline, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS headline,
  concat_ws(': ', nullif(headline, ''), nullif(summary, '')) AS line FROM event_scores""")
def str_escape(t) -> DataFrame:  # noqa: ANN001
    """STR-F6, STR-F11."""
    return t("event_scores").select("event_id", text.html_escape(F.col("headline")).alias("headline"), text.present(F.col("headline"), F.col("summary"), separator=": ").alias("line"))


@_query("SELECT id, json_extract_string(payload_json, '$.quote_author') AS quote_author, json_extract_string(payload_json, '$.quote_text') AS quote_text FROM publication_outbox")
def prj_payload(t) -> DataFrame:  # noqa: ANN001
    """PRJ-08, JSN-F2."""
    return t("publication_outbox").select("id", *(values.json_text(F.col("payload_json"), f"$.{c}").alias(c) for c in ("quote_author", "quote_text")))


@_query("""SELECT seq, coalesce(json_extract_string(engagement_json, '$.likes')::BIGINT, 0) AS likes, coalesce(json_extract_string(engagement_json, '$.replies')::BIGINT, 0) AS replies,
  coalesce(json_extract_string(engagement_json, '$.views')::BIGINT, -1) AS views FROM radar_events""")
def prj_engagement(t) -> DataFrame:  # noqa: ANN001
    """PRJ-02, JSN-F1, JSN-F3."""
    n = lambda c: values.json_typed(F.col("engagement_json"), f"$.{c}", "bigint")
    return t("radar_events").select("seq", F.coalesce(n("likes"), F.lit(0)).alias("likes"), F.coalesce(n("replies"), F.lit(0)).alias("replies"), F.coalesce(n("views"), F.lit(-1)).alias("views"))


@_query("""SELECT seq, greatest(0, (epoch_us(TIMESTAMP '2026-03-03') - epoch_us(published_at)) // 60000000)::BIGINT AS age_minutes, substr(original_text, 1, 200) AS text FROM radar_events""")
def prj_messages(t) -> DataFrame:  # noqa: ANN001
    """PRJ-05, DTE-F7."""
    now = F.lit(NOW).cast("timestamp_ntz")
    return t("radar_events").select("seq", values.age_minutes(F.col("published_at"), now).alias("age_minutes"), text.clip(F.col("original_text"), 200).alias("text"))


@_query("""SELECT seq, date_trunc('minute', discovered_at) AS minute, date_trunc('month', discovered_at) AS month,
  date_trunc('day', discovered_at + INTERVAL 7 HOUR) - INTERVAL 7 HOUR AS local_day, strftime(discovered_at + INTERVAL 7 HOUR, '%d.%m %H:%M') AS local_text FROM radar_events""")
def dte_times(t) -> DataFrame:  # noqa: ANN001
    """DTE-F4, DTE-F5, DTE-F6, DTE-F8."""
    d = F.col("discovered_at").cast("timestamp")
    ntz = lambda c: c.cast("timestamp_ntz")
    return t("radar_events").select("seq", ntz(values.minute(d)).alias("minute"), ntz(values.month(d)).alias("month"), ntz(values.local_day(d, ZONE)).alias("local_day"), values.local_text(d, ZONE).alias("local_text"))


@_query("""SELECT seq, make_timestamp(((external_id::BIGINT >> 22) + 1288834974657) * 1000) AS made FROM radar_events WHERE source = 'x' AND regexp_matches(external_id, '^[0-9]{1,18}$')""")
def dte_snowflake(t) -> DataFrame:  # noqa: ANN001
    """DTE-F3."""
    rows = t("radar_events").where("source = 'x' AND external_id RLIKE '^[0-9]{1,18}$'")
    return rows.select("seq", values.snowflake_time(F.col("external_id")).cast("timestamp_ntz").alias("made"))


@_query(r"""SELECT *, greatest(0, least(100, qmemo_relevance + quote_strength + discussion_potential + 15 + 9 + 8 - risk_penalty)) AS total FROM (
  SELECT seq, CASE WHEN contains(normalized_text, 'quote') OR contains(normalized_text, 'prediction') OR contains(normalized_text, 'said') THEN 27 ELSE 18 END AS qmemo_relevance,
    CASE WHEN contains(original_text, '"') THEN 18 ELSE 12 END AS quote_strength,
    least(15, 7 + coalesce(json_extract_string(engagement_json, '$.replies')::BIGINT, 0) // 10)::INT AS discussion_potential,
    CASE WHEN contains(normalized_text, 'rumor') THEN 3 ELSE 0 END AS risk_penalty FROM radar_events)""")
def score_offline(t) -> DataFrame:  # noqa: ANN001
    """UDF-03, AGG-11, STR-F10, MTH-F1, MTH-F3."""
    return score.offline(t("radar_events").select("seq", "normalized_text", "original_text", "engagement_json")).select("seq", "qmemo_relevance", "quote_strength", "discussion_potential", "risk_penalty", "total")


@_query("""SELECT event_id, total AS stored, greatest(0, least(100, qmemo_relevance + quote_strength + discussion_potential + freshness + clarity + action_likelihood - risk_penalty)) AS total
  FROM event_scores""")
def score_totals(t) -> DataFrame:  # noqa: ANN001
    """AGG-11: totals made again."""
    return t("event_scores").select("event_id", F.col("total").alias("stored"), score.total().alias("total"))


@_query("""SELECT source_key, count(*) FILTER (f AND (ok IS NULL OR seq > ok)) AS failures, coalesce(max(ok), 0) AS last_success, coalesce(max(seq) FILTER (f), 0) AS last_failure FROM (
  SELECT source_key, seq, filter_reason IS NOT NULL AS f, max(seq) FILTER (filter_reason IS NULL) OVER (PARTITION BY source_key) AS ok FROM radar_events) GROUP BY source_key""")
def fold_health(t) -> DataFrame:  # noqa: ANN001
    """STM-12, SNK-03: filtered items at the end of each source's log."""
    return folds.streaks(t("radar_events").select("source_key", "seq", "filter_reason"), "source_key", F.col("filter_reason").isNotNull()).fillna(0, ["last_success", "last_failure"])


@_query("SELECT CASE source WHEN 'x' THEN 'X' WHEN 'rss' THEN 'Feeds' WHEN 'gdelt' THEN 'Quotes' ELSE source END AS label, count(*) AS n FROM radar_events GROUP BY 1")
def lbl_sources(t) -> DataFrame:  # noqa: ANN001
    """LBL-F1, CND-F1."""
    return t("radar_events").select(values.label(F.col("source"), {"x": "X", "rss": "Feeds", "gdelt": "Quotes"}).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@_query(r"""SELECT seq, regexp_extract(u, '^https://x\.com/[A-Za-z0-9_]{1,15}/status/([0-9]{1,19})/?(\?[^\s#]*)?$', 1) AS post FROM (
  SELECT seq, replace(url, 'https://x.example/', 'https://x.com/') AS u FROM radar_events) WHERE regexp_matches(u, '^https://x\.com/[A-Za-z0-9_]{1,15}/status/[0-9]{1,19}/?(\?[^\s#]*)?$')""")
def flt_post_links(t) -> DataFrame:  # noqa: ANN001
    """FLT-11."""
    url = F.replace("url", F.lit("https://x.example/"), F.lit("https://x.com/"))
    return t("radar_events").select("seq", urls.post_id(url).alias("post")).where("post IS NOT NULL")


@_query("SELECT event_id, unnest(string_split(rationale, ' ')) AS word FROM event_scores")
def arr_words(t) -> DataFrame:  # noqa: ANN001
    """ARR-F1."""
    return t("event_scores").select("event_id", F.explode(F.split("rationale", " ")).alias("word"))


@_query("SELECT id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, id) AS k FROM publication_outbox) WHERE k = 1")
def snk_idempotent(t) -> DataFrame:  # noqa: ANN001
    """SNK-05: one row for each idempotency key, the first."""
    return read_models.latest(t("publication_outbox"), "idempotency_key", F.col("created_at"), F.col("id")).select("id", "event_id")


@_query("SELECT count(*) AS n, count(DISTINCT message_id) AS messages, min(delivered_at) AS first, max(delivered_at) AS last, chat_id FROM telegram_deliveries GROUP BY chat_id")
def agg_chats(t) -> DataFrame:  # noqa: ANN001
    """AGG-04: deliveries of each chat."""
    return t("telegram_deliveries").groupBy("chat_id").agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("messages"), F.min("delivered_at").alias("first"), F.max("delivered_at").alias("last"))


@_query("""SELECT CASE WHEN status IN ('DISCOVERED', 'SHORTLISTED', 'NOTIFIED', 'SNOOZED', 'DRAFTED', 'SCORED') AND discovered_at < TIMESTAMP '2026-03-02' THEN 'EXPIRED' ELSE status END AS status,
  count(*) AS n FROM radar_events GROUP BY 1""")
def stm_expired(t) -> DataFrame:  # noqa: ANN001
    """STM-09."""
    rows = upkeep.expired(t("radar_events").select("status", "discovered_at"), SINCE, ["DISCOVERED", "SHORTLISTED", "NOTIFIED", "SNOOZED", "DRAFTED", "SCORED"])
    return read_models.counts(rows, "status")


@_query("""SELECT id, CASE status WHEN 'RUNNING' THEN 'FAILED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN coalesce(finished_at, TIMESTAMP '2026-03-03') ELSE finished_at END AS finished_at
  FROM pipeline_runs WHERE finished_at IS NOT NULL OR status = 'RUNNING'""")
def stm_closed_runs(t) -> DataFrame:  # noqa: ANN001
    """STM-14, CAS-14."""
    return upkeep.closed_runs(t("pipeline_runs"), NOW).where("finished_at IS NOT NULL").select("id", "status", "finished_at")


@_query("""SELECT seq, CASE WHEN m < INTERVAL 9 HOUR THEN d + INTERVAL 9 HOUR WHEN m < INTERVAL 18 HOUR THEN d + INTERVAL 18 HOUR ELSE d + INTERVAL 33 HOUR END - INTERVAL 7 HOUR AS slot
  FROM (SELECT seq, date_trunc('day', l) AS d, l - date_trunc('day', l) AS m FROM (SELECT seq, discovered_at + INTERVAL 7 HOUR AS l FROM radar_events))""")
def srt_next_slot(t) -> DataFrame:  # noqa: ANN001
    """SRT-10, STM-16."""
    slot = upkeep.next_slot(F.col("discovered_at").cast("timestamp"), ["09:00", "18:00"], ZONE)
    return t("radar_events").select("seq", slot.cast("timestamp_ntz").alias("slot"))


@_query("""SELECT e.id, s.total FROM radar_events e JOIN event_scores s ON s.event_id = e.id WHERE e.status = 'SHORTLISTED'
  QUALIFY row_number() OVER (ORDER BY s.total DESC, e.id) <= greatest(0, least(5, 1000000 - (SELECT count(*) FROM telegram_deliveries WHERE delivered_at >= TIMESTAMP '2026-03-02')))""")
def srt_budgeted(t) -> DataFrame:  # noqa: ANN001
    """SRT-08."""
    rows = read_models.scored(t("radar_events").where("status = 'SHORTLISTED'").select("id"), t("event_scores").select("event_id", "total"))
    allowed = upkeep.allowance(t("telegram_deliveries"), SINCE, 5, 1_000_000)
    return upkeep.budgeted(rows, allowed, 5, F.desc("total"), F.col("id")).select("id", "total")


@_query("""SELECT source_key AS key, arg_max(status, seq) AS value FROM radar_events GROUP BY source_key""")
def stm_state(t) -> DataFrame:  # noqa: ANN001
    """STM-13, CAS-15: the last value of each key of a log."""
    return upkeep.state(t("radar_events").select("seq", F.col("source_key").alias("key"), F.col("status").alias("value")))


@_query("SELECT CAST(json_object('status', status, 'n', count(*)) AS VARCHAR) AS report FROM radar_events GROUP BY status")
def snk_report(t) -> DataFrame:  # noqa: ANN001
    """SNK-08."""
    return upkeep.reported(read_models.counts(t("radar_events"), "status"))
