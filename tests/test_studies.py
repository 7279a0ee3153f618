"""The resumable sweep, and windows before gaps by hand."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacunae.operators import hac, inject, models, profile, summary
from lacunae.operators.blocked import placed
from lacunae.plans import evaluation, studies
from lacunae.sources import readers

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")
def test_a_broken_sweep_goes_on(spark, tmp_path, monkeypatch):
    ran = []
    made = studies.injection_sweep

    def watched(spark, d, horizon, placements):
        ran.append((horizon, *placements))
        if len(ran) == 2:
            raise RuntimeError("broken off")
        return made(spark, d, horizon, placements)

    monkeypatch.setattr(studies, "injection_sweep", watched)
    path = str(tmp_path / "sweep")
    with pytest.raises(RuntimeError):
        studies.resume_sweep(spark, SF, path, (1,), (0, 1))
    before = sorted(map(str, spark.read.parquet(path).collect()))
    assert before and studies.resume_sweep(spark, SF, path, (1,), (0, 1)) == [(1, 1)]  # the rest only
    after = spark.read.parquet(path)
    assert sorted(map(str, after.where("placement = 0").collect())) == before and after.select("placement").distinct().count() == 2
    assert studies.resume_sweep(spark, SF, path, (1,), (0, 1)) == [] and ran == [(1, 0), (1, 1), (1, 1)]


def test_parts_without_rows_are_done(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([], "x int, part int")
    parts = spark.createDataFrame([(1,), (2,)], "part int")
    assert readers.unfinished(parts, path, ["part"]).count() == 2
    readers.write_part(rows, path, {"part": 2})
    assert [r.part for r in readers.unfinished(parts, path, ["part"]).collect()] == [1]


def test_context_windows(spark):
    rng = np.random.default_rng(1)
    v = [None if k in (20, 21, 40, 44, 90) else float(rng.integers(0, 50)) for k in range(120)]
    df = spark.createDataFrame([("s", 10 * k, x) for k, x in enumerate(v)], "series_id string, t bigint, v double")
    got = profile.context_windows(df, 6, 10).collect()
    starts = [i for i in range(1, 120) if v[i] is None and v[i - 1] is not None]
    stats = lambda seg: (float(np.std(np.diff(seg))), float(np.max(np.abs(np.diff(seg)))))
    want = []
    for i in starts:
        seg = v[max(0, i - 6) : i]
        there = [x for x in seg if x is not None]
        if len(there) >= 5:
            want.append(("legacy", True, *stats(there)))
        if len(seg) == 6 == len(there):
            want.append(("clean", True, *stats(seg)))
    for j in range(6, 120):
        seg = v[j - 6 : j]
        if None not in seg:
            if j % 6 == 0 and all(abs(s - j) > 6 for s in starts):
                want.append(("clean", False, *stats(seg)))
            if (j - 6) % 3 == 0:
                want.append(("legacy", False, *stats(seg)))
    round_ = lambda rows: sorted((m, b, round(s, 9), round(r, 9)) for m, b, s, r in rows)
    assert round_((r.method, r.before_gap, r.sd, r.ramp) for r in got) == round_(want)


def test_missing_tables_are_told(spark):
    df = spark.createDataFrame([("c", 1, 2.0)], "condition string, n bigint, mean double")
    got = {(r.table, r.stat): r.value for r in summary.collate({"a": df, "b": None}, "condition", {"a": ["n", "mean"], "b": ["n"]}, spark).collect()}
    assert got == {("a", "n"): 1.0, ("a", "mean"): 2.0, ("b", "missing"): None}
    assert summary.reliable_share(df.withColumn("bias", F.lit(3.0)), "bias", 2.0).first().share == 0.0


def test_models_share_one_sweep(spark, monkeypatch):
    called, row = [], spark.createDataFrame([("pair", "FEW-LONG", 1.0)], "model string, condition string, bias double")
    monkeypatch.setattr(studies, "injection_sweep", lambda *_, **more: called.append(more) or row)
    assert studies.sweep_by_model(spark, SF).count() == 1 and [list(c["models"]) for c in called] == [["pair", "level"]]


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")
def test_horizons_share_the_copies(spark, tmp_path, monkeypatch):
    ran, made = [], evaluation.placed

    def watched(*a):
        ran.append(a)
        return made(*a)

    monkeypatch.setattr(evaluation, "placed", watched)
    assert studies.resume_sweep(spark, SF, str(tmp_path / "sweep"), (1, 3), (0,)) == [(1, 0), (3, 0)]
    assert len(ran) == 1 and spark.read.parquet(str(tmp_path / "sweep")).select("horizon").distinct().count() == 2


def test_errors_from_moments_are_those_of_predictions(spark):
    rng = np.random.default_rng(2)
    rows = [(k, role, *map(float, rng.normal(5, 2, 2)), None if i == 3 else float(rng.normal(4, 1)), 2.5) for k in ("a", "b") for role in ("train", "test") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, role string, x0 double, x1 double, target double, v double")
    train, test = df.where("role = 'train'"), df.where("role = 'test'")
    want = models.predict_ridge(test, models.fit_ridge(train, ["x0", "x1"], keys=["k"]), ["x0", "x1"], ["k"])
    want = {r.k: (r.e, r.p) for r in want.groupBy("k").agg(F.avg((F.col("target") - F.col("prediction")) ** 2).alias("e"), F.avg((F.col("target") - F.col("v")) ** 2).alias("p")).collect()}
    m = models.moments(["x0", "x1", "target"], F.col("role") == "train", F.col("target") - F.col("v"))
    both = df.groupBy("k").pivot("role", ["train", "test"]).agg(m)
    got = {r.k: (r.e, r.p) for r in both.select("k", models.ridge_error("train", "test").alias("e"), F.col("test.square").alias("p")).collect()}
    assert set(got) == {"a", "b"} and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_copies_lose_the_planned_places(spark):
    rows = [(s, 3600 * (k + (k > 100) * 5), float(k)) for s in ("a", "b") for k in range(300)]
    intact = placed(spark.createDataFrame(rows, "series_id string, t bigint, v double"), 3600)
    seg, runs = evaluation.injected_copies(intact, (0,))
    assert runs.count() == 12
    name = ["run", "record", "condition", "share", "placement", "nominal"]
    nominal = F.element_at(F.create_map(*[F.lit(x) for c in evaluation.CONDITIONS for x in c]), F.col("condition"))
    plan = inject.plan_gaps(runs.withColumn("n", F.lit(300)).withColumn("nominal", nominal), F.floor(F.col("n") * F.col("share")), F.col("nominal"), 5, 20, name)
    lost = {(r.run, k) for r in plan.collect() for k in range(r.start, r.start + r.length)}
    want = {(r.run, t) for r in runs.collect() for k, (_, t, _) in enumerate(x for x in rows if x[0] == r.record) if (r.run, k) not in lost}
    assert lost and {(r.run, r.t) for r in seg.join(runs, "rid").collect()} == want


def test_small_groups_rank_alike(spark):
    df = spark.createDataFrame([(s, float(k * 7 % 5), float(k * 3 % 4)) for s in ("a", "b") for k in range(20)], "series_id string, x double, y double")
    assert sorted(hac.spearman(df, "x", "y", few=True).collect()) == sorted(hac.spearman(df, "x", "y").collect())
