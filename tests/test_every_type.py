"""Injected gaps in the series of all event types, against SQL and against the events."""

from pathlib import Path

import duckdb
import pytest

from lacunae.registry import REGISTRY

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["inject_stratified", "injected_gaps", "injection_bias", "summary_grouping_sets", "survival_grid"])
def test_all_types(spark, name):
    query, sql = REGISTRY[f"{name}_every_type"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = con.sql(sql)
    df = query(spark, str(FOLDER))
    got = df.select(want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))
    types = {r[0] for r in con.sql("SELECT DISTINCT event_type FROM events").fetchall()}
    assert len(types) == 5 and REGISTRY[name] == REGISTRY[f"{name}_every_type"]
    if "series_id" in df.columns:
        assert {r["series_id"] for r in got} == types
