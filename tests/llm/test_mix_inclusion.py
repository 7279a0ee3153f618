"""How often documents of each size enter the mix: every source is one group of 128, so sources stand for repeated draws."""

import pytest

from lacunae.llm import pivotal_mix as pm


@pytest.mark.parametrize("rate", [0.25, 0.75])
def test_inclusion_does_not_depend_on_size(spark, rate):
    rows = [(128 * s + k, " ".join(["w"] * (100 if k % 10 == 0 else 10)), f"s{s:03}") for s in range(150) for k in range(128)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4).cache()
    taken = {10: [], 100: []}
    for seed in (1, 2):
        for r in pm.mix(docs, weights=(1,), share=rate, seed=seed).select("size", "copies").collect():
            taken[r["size"]].append(r["copies"])
    for size, copies in taken.items():
        assert sum(copies) / len(copies) == pytest.approx(rate, abs=0.025), size
