"""Substring dedup of rows that share a doc_id but not their text, against brute force for each row."""

import random
from collections import Counter

import pytest

from lacunae.llm import substring_dedup as sd

from .test_operators import slow_removal


@pytest.mark.parametrize("window", [13, 6])
def test_rows_of_one_id_with_different_texts(spark, window):
    rng = random.Random(window)
    passage = " ".join(f"shared{n}" for n in range(20))
    plain = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = [(1, f"{plain(30)} {passage} {plain(30)}"), (2, f"{plain(60)} {passage} {plain(5)}"), (2, plain(15)), (2, f"{passage} {plain(40)}"), (2, None), (2, f"{passage} {plain(2)}"), (None, passage)]
    rows += [(3, rows[1][1]), (3, rows[1][1]), (3, plain(14)), (4, passage), (4, plain(50))]
    rows += [(rng.randrange(5, 15), " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sd.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == slow_removal(rows, window)


def test_levels():
    assert [sd.levels(n) for n in (1, 2, 6, 13, 14, 26, 50)] == [[1, 1], [1, 2], [3, 6], [7, 13], [7, 14], [7, 13, 26], [7, 13, 25, 50]]


@pytest.mark.parametrize(("window", "buckets"), [(1, 8), (26, 8), (26, 20), (50, 8), (60, 8)])
def test_more_than_two_levels(spark, monkeypatch, window, buckets):
    """Longer windows go over more levels; of 60 words nothing repeats, so a level leaves no candidate."""
    monkeypatch.setattr(sd, "buckets_for", lambda *_: buckets)
    rng = random.Random(window)
    plain = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [plain(n) for n in (30, 55, 12, 26, 51)]
    rows = [(k % 25, " ".join([*plain(rng.randrange(8)), *passages[k % 5][rng.randrange(3) :], *plain(rng.randrange(40))])) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " ".join(passages[1] + passages[0])), (None, " ".join(passages[1]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sd.remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == slow_removal(rows, window)
