from __future__ import annotations

from datetime import datetime, timedelta

from tideline.operators import late

SCHEMA = "seq bigint, run_id string, source string, external_id string, source_key string, published_at timestamp_ntz, discovered_at timestamp_ntz, late string"
H = datetime(2026, 1, 1, 10)


def _row(seq, run, ext, key="k", published=H, after_end=0.0, source="s"):
    found = None if after_end is None else H + timedelta(hours=1 + after_end)
    return seq, run, source, ext, key, published, found, "clash"


def test_corrections_and_cut_off(spark):
    rows = [
        _row(1, "a", "1"), _row(2, "a", "2", after_end=1.0), _row(3, "b", "3", after_end=1.001), _row(4, "b", "4", after_end=2),
        _row(5, "c", "5", after_end=72), _row(6, "d", "6", after_end=72.001), _row(7, "d", "1", after_end=5),
        _row(8, "e", "7", key=None, after_end=5), _row(9, "e", "8", published=None, after_end=5), _row(10, "e", "9", after_end=None),
        _row(11, "f", None, after_end=6), _row(12, "f", None, after_end=6), _row(13, None, "x", after_end=7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.run_id, r.source_key, r.hour_start) for r in late.corrections(df).collect()}
    hour = "2026-01-01 10:00:00"
    assert found == {("b", "k", hour), ("c", "k", hour), ("f", "k", hour), (None, "k", hour)}
    seen = {(r.late, r.run_id): (r.cell_items, r["items"], r.report_no) for r in late.revisions(df).collect()}
    assert seen == {(False, None): (2, 2, 1), (True, "b"): (2, 4, 2), (True, "c"): (1, 5, 3), (True, "f"): (2, 7, 4), (True, None): (1, 8, 5)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert late.corrections(df).collect() == [] and late.revisions(df).collect() == []
