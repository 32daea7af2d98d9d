from __future__ import annotations

from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_names_the_llm_subpackage():
    core = [p for p in (ROOT / "tideline").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert core and not [p for p in core if "tideline.llm" in p.read_text() or "import llm" in p.read_text()]


def test_names():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert {"p2_found", "p2_revisions", "flt_first_reason"} <= set(queries)


def test_shared_folder_is_read_from_the_session(spark):
    from tideline.session import materialize, shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]
