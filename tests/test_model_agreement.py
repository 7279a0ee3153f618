"""The agreement is one of all model families of the evaluation, and comes with the channels' shares."""

from pyspark.sql import functions as F

from lacunae.plans import evaluation


def test_agreement_asks_the_forest_too(spark, monkeypatch):
    rows = [(s, t, 0.0, 1.0, t < 3 or arm != "c", arm, "test") for s in "pqr" for arm in "abc" for t in range(4 if arm == "c" else 3)]
    df = spark.createDataFrame(rows, "series_id string, t int, v double, target double, in_a boolean, arm string, role string")
    # biases of ridge, boosted trees and forest: p 10, 20, -10; q 10, 20, 5; r has no forest
    gains = {"ridge": {"p": 0.1, "q": 0.1, "r": 0.1}, "boosted": {"p": 0.2, "q": 0.2, "r": 0.2}, "forest": {"p": -0.1, "q": 0.05, "r": None}}
    asked = {}

    def predicted(rows, model, n, by):
        asked[model] = {r.arm for r in rows.select("arm").distinct().collect()}
        gain = F.create_map(*[F.lit(x) for pair in gains[model].items() for x in pair])[F.col("series_id")]
        return rows.withColumn("prediction", 0.5 + F.when(F.col("arm") == "c", gain).when(gain.isNotNull(), 0.0))

    monkeypatch.setattr(evaluation, "arm_rows", lambda *_, **__: df)
    monkeypatch.setattr(evaluation, "_predicted", predicted)
    got = {r["series_id"]: r.asDict() for r in evaluation.model_agreement(spark, "").collect()}
    assert set(asked) == {"ridge", "boosted", "forest"} and asked["ridge"] == asked["boosted"] == set("abc") and asked["forest"] >= set("ac")
    assert {s: (r["n"], r["agree"], r["least"], r["most"]) for s, r in got.items()} == {"p": (3, False, -10.0, 20.0), "q": (3, True, 5.0, 20.0), "r": (2, True, 10.0, 20.0)}
    for r in got.values():  # training alone, of ridge and boosted trees
        assert (r["feature"], r["training"], r["composition"], r["total"]) == (0.0, 15.0, 0.0, 15.0)
        assert (r["share_feature"], r["share_training"], r["share_composition"]) == (0.0, 100.0, 0.0)
