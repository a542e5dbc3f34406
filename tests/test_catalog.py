"""Named queries against their SQL twins in DuckDB on the smallest tables, and plan checks."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from placetime.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load_all()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
SAMPLE = [
    "monthly_by_district", "monthly_distinct", "composition_share", "hour_histogram", "corner_monthly", "kpi_chips", "shares",
    "polygon_assign_holes", "stop_ring_counts", "knn_neighbours", "snap_intersection", "hexbin", "cell_classes_multiwindow",
    "cell_breakdown", "lag_stats", "month_completeness", "cohort_summary", "publication_delta", "before_after", "detect_onset",
    "concentration_curve", "relative_intensity", "nearest_alternative", "resolve_intersection", "sequence_ids", "apply_changes",
    "dedup_id_first", "lever_events", "reconcile", "systematic_sample", "stream_counts", "late_policy",
    "month_mask", "dictionary_encode", "feed_csv", "fallback_feed", "week_partner", "verdicts", "event_radius_join", "local_index",
    "match_hotspot_first", "stop_checks", "validate_interventions", "validate_links", "search_stops", "classifier_parity", "stream_weekly",
    "newest_month_peek", "calendar_labels", "known_breaks", "third_kpi", "stored_documents", "reproduced_total", "filter_drift", "lever_rows", "provenance_filters", "filter_parity", "stream_hold_back", "stream_dedup",
    "group_rows", "class_fuzz", "shard_update",
]
NAMES = list(ORACLES) if os.environ.get("ALL_QUERIES") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and pd.isna(v)):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without placetime/llm and tests/llm, with and without corpus_pipeline.py, still lists every other query."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for left_out in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(left_out))
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(*left_out, ".git", "__pycache__"))
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
        got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
        assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], got.stderr


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["polygon_assign", "nearest_within", "event_radius_join", "cell_classes", "densify_sparse", "match_intersection"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name, columns", [("hour_brush", {"ts", "event_type"}), ("excluded_category_yearly", {"o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"})])
def test_scans_read_only_what_they_use(spark, name, columns):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and ("events.parquet" in line or "orders.parquet" in line))
    read = scan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} <= columns
