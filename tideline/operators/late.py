"""Event-time aggregates corrected by late arrivals (SQL only).

The triangle has one cell for each series, event period (hour of publication) and arrival period (the run that
brought the rows); rows that came in time form the first arrival period.  Summing the cells of an hour along the
arrivals gives every revision of its count.  Arrivals beyond the cut-off are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_COUNTED = """
SELECT r.seq AS seq, r.run_id AS run_id, r.source_key AS source_key, date_trunc('HOUR', r.published_at) AS hour_start,
       r.discovered_at AS discovered_at
FROM (
  SELECT min_by(struct(seq, run_id, source_key, published_at, discovered_at), seq) AS r
  FROM {rows} WHERE seq IS NOT NULL
  GROUP BY source, external_id, CASE WHEN source IS NULL OR external_id IS NULL THEN seq END
)
WHERE r.source_key IS NOT NULL AND r.published_at IS NOT NULL AND r.discovered_at IS NOT NULL
"""

_CELLS = """
SELECT source_key, hour_start, late, run_id, count(*) AS cell_items, min(seq) AS first_seq
FROM (
  SELECT source_key, hour_start, seq,
         discovered_at > hour_start + {report} AS late,
         CASE WHEN discovered_at > hour_start + {report} THEN run_id END AS run_id
  FROM {counted}
  WHERE discovered_at <= hour_start + {cutoff}
)
GROUP BY source_key, hour_start, late, run_id
"""

_REVISIONS = """
SELECT source_key, date_format(hour_start, 'yyyy-MM-dd HH:mm:ss') AS hour_start, late, run_id,
       cell_items,
       sum(cell_items) OVER arrivals AS items,
       row_number() OVER arrivals AS report_no
FROM {cells}
WINDOW arrivals AS (PARTITION BY source_key, hour_start ORDER BY late, first_seq, run_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_CORRECTIONS = """
SELECT run_id, source_key, hour_start
FROM (
  SELECT *, lag(items) OVER (PARTITION BY source_key, hour_start ORDER BY report_no) AS items_before FROM {revisions}
)
WHERE late AND items > coalesce(items_before, 0)
"""


def cells(rows: DataFrame, *, report_hours: int = 1, cutoff_hours: int = 72) -> DataFrame:
    """Cells of the triangle: source_key, hour_start, late, run_id, cell_items, first_seq.

    rows: seq, run_id, source, external_id, source_key, published_at, discovered_at; other columns are ignored.
    Only the first arrival (smallest seq) of each (source, external_id) counts; a row that lacks one of the two has
    no identity to share and counts by itself.  Rows without seq have no place in the order of arrival and are left
    out.  Rows without source_key, published_at or discovered_at belong to no
    cell.  An hour is reported report_hours after its end; a row discovered later is late, one discovered more than
    cutoff_hours after the end is dropped.  late is false and run_id null for the rows in time; a late row without
    run_id is in the cell of the null run.  One scan, and one narrow row per identity and task is shuffled, so a key
    that holds a third of all rows costs no more than any other.
    """
    spark = rows.sparkSession
    counted = spark.sql(_COUNTED, rows=rows)
    hours = "INTERVAL '{}' HOUR"
    return spark.sql(
        _CELLS.replace("{report}", hours.format(1 + report_hours)).replace("{cutoff}", hours.format(1 + cutoff_hours)),
        counted=counted,
    )


def revisions(rows: DataFrame, *, report_hours: int = 1, cutoff_hours: int = 72) -> DataFrame:
    """Every report of every hour: source_key, hour_start, late, run_id, cell_items, items, report_no.

    items is the count after that arrival.  The windows hold the runs between an hour's end and its cut-off, so
    their size is bounded by the cut-off and not by the data.  Empty input gives no rows.
    """
    return rows.sparkSession.sql(_REVISIONS, cells=cells(rows, report_hours=report_hours, cutoff_hours=cutoff_hours))


def corrections(rows: DataFrame, *, report_hours: int = 1, cutoff_hours: int = 72) -> DataFrame:
    """run_id, source_key, hour_start of each run that corrects a reported hour: its revision differs from the one before."""
    return rows.sparkSession.sql(_CORRECTIONS, revisions=revisions(rows, report_hours=report_hours, cutoff_hours=cutoff_hours))
