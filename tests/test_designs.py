"""Only the features that are asked for are written, and a table's parts read one placed series."""

from pathlib import Path

import pytest

from lacunae.plans import evaluation, modelling

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")
def test_mixture_table_reads_one_series(spark, monkeypatch):
    ran, kept = [], []
    places, stored = evaluation.placed_rows, modelling.stored
    monkeypatch.setattr(evaluation, "placed_rows", lambda *a: ran.append(a) or places(*a))
    monkeypatch.setattr(modelling, "stored", lambda df, name: kept.append(df.columns) or stored(df, name))
    assert evaluation.mixture_table(spark, SF).count() > 0
    assert len(ran) == 1 and len(kept) == len(evaluation.HORIZONS)
    assert all({c for c in columns if c[:2] in ("a_", "n_")} == {"a_lag_0", "a_kalman", "n_lag_0", "n_kalman"} for columns in kept)
