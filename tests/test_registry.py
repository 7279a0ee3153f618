"""Every registered query of the series operators against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lacunae.registry import REGISTRY

FOLDER = Path("/root/testdata/sf0.001")
TABLES = [p.stem for p in FOLDER.glob("*.parquet")]
QUICK = ["exposure_report", "fill_short_gaps", "gap_report", "distance_from_gap", "kalman_segmented", "calendar_split", "displaced_split", "mann_whitney_u", "injected_gaps", "summary_grouping_sets"]


@pytest.mark.skipif(not TABLES, reason="the test tables aren't here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    query, sql = REGISTRY[name]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(d[0] for d in want.description)
    place = [[d[0] for d in want.description].index(n) for n in names]
    rows = sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())
    df = query(spark, str(FOLDER))
    assert sorted(df.columns) == names
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == rows


@pytest.mark.skipif(not TABLES, reason="the test tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(REGISTRY) > 80
