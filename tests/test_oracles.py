"""Every registered query against its DuckDB oracle (rows-only where none)."""

from __future__ import annotations

import pytest

from ferryman.plans import registry
from ferryman.plans.check import compare, duck_connect

from .conftest import SF_SMOKE

KEYS = sorted(registry.queries())
ROWS_ONLY: set[str] = set()


def test_inventory_complete():
    assert len(KEYS) == 128
    assert set(KEYS) - set(registry.oracle_sql()) == ROWS_ONLY


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMOKE)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, key, registry.queries()[key], registry.oracle_sql().get(key), SF_SMOKE, con)
    if key in ROWS_ONLY:
        assert r["status"] == "rows-only" and r["spark_rows"] > 0
    else:
        assert r["status"] == "ok", r


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert "revenue" in df.columns


TZ_KEYS = ["staged_pipeline", "step_progress", "job_latest", "job_outcome", "job_log", "step_transitions",
           "sort_stage", "runtime_params", "load_timestamp", "sas_scalars", "incremental_model", "cobol_date",
           "filter_stage"]


@pytest.mark.parametrize("key", TZ_KEYS)
def test_results_do_not_depend_on_session_time_zone(spark, con, key):
    """The driver's own session need not be UTC: results must not move."""
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        r = compare(spark, key, registry.queries()[key], registry.oracle_sql().get(key), SF_SMOKE, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r["status"] == "ok", r


def test_stream_state_does_not_depend_on_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        la = sorted(registry.queries()["job_state_stream"](spark, SF_SMOKE).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert la == sorted(registry.queries()["job_state_stream"](spark, SF_SMOKE).collect())
