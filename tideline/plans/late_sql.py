"""Problem 2: late and out-of-order events."""

from __future__ import annotations

from tideline.operators import late
from tideline.session import table

QUERIES = {
    "p2_found": lambda spark, d: late.corrections(table(spark, d, "radar_events")),
    "p2_revisions": lambda spark, d: late.revisions(table(spark, d, "radar_events")),
}

_COUNTED = """
WITH counted AS (
  SELECT seq, run_id, source_key, date_trunc('hour', published_at) AS h, discovered_at
  FROM (SELECT *, row_number() OVER (PARTITION BY source, external_id ORDER BY seq) AS k FROM radar_events)
  WHERE (k = 1 OR source IS NULL OR external_id IS NULL) AND source_key IS NOT NULL
    AND published_at IS NOT NULL AND discovered_at IS NOT NULL
), cells AS (
  SELECT source_key, h, discovered_at > h + INTERVAL 2 HOUR AS late,
         CASE WHEN discovered_at > h + INTERVAL 2 HOUR THEN run_id END AS run_id,
         count(*) AS cell_items, min(seq) AS first_seq
  FROM counted WHERE discovered_at <= h + INTERVAL 73 HOUR GROUP BY ALL
)
"""

ORACLE = {
    "p2_found": _COUNTED + "SELECT run_id, source_key, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start FROM cells WHERE late",
    "p2_revisions": _COUNTED
    + """SELECT source_key, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour_start, late, run_id, cell_items,
  CAST(sum(cell_items) OVER w AS BIGINT) AS items, row_number() OVER w AS report_no
FROM cells WINDOW w AS (PARTITION BY source_key, h ORDER BY late, first_seq, run_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
}
