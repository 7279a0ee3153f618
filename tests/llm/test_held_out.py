"""Quality of the trained operators on the rows that they never learn from, on the given tables."""

from pathlib import Path

import numpy as np
import pytest

from lacunae.llm.registry import REGISTRY

FOLDER, LARGER = Path("/root/testdata/sf0.01"), Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not LARGER.exists(), reason="the test tables aren't here")
def test_toxicity(spark):
    got = REGISTRY["op4_toxicity_mil"][0](spark, str(LARGER)).where("held_out").select("doc_id", "score", "predicted")
    rows = got.join(spark.read.parquet(f"{LARGER}/labels.parquet").where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").collect()
    score, said, toxic = (np.array(x, float) for x in zip(*rows, strict=True))
    above = (score[toxic == 1][:, None] > score[toxic == 0][None, :]).mean() + (score[toxic == 1][:, None] == score[toxic == 0][None, :]).mean() / 2
    print("toxicity held out:", len(rows), "rows, AUC", above, "precision", toxic[said == 1].mean(), "recall", said[toxic == 1].mean())
    assert above > 0.95


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't here")
def test_language(spark):
    got = REGISTRY["op7_language_cnn"][0](spark, str(FOLDER)).where("held_out and lang_pred <> 'und'").select("doc_id", "lang_pred")
    rows = got.join(spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    right = np.mean([r.lang == r.lang_pred for r in rows])
    print("language held out:", len(rows), "rows, accuracy", right)
    assert right > 0.95
