"""Items without an id, rows of one id with different texts in the mix, and paths named as the ledger's own columns."""

import hashlib
from collections import Counter

import pytest

from lacunae.llm import benchmark_decontamination as bd
from lacunae.llm import pivotal_mix as pm
from lacunae.llm import secret_ledger as sl
from lacunae.llm.common import fresh_path


def test_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "one two three")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, "b c d e f g h i j k"), (7, "c d e f g h i j k l"), (None, "x y z")], "item_id bigint, text string")
    got = {r.doc_id: r for r in bd.find_contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items) == (11, 2, ["7"]) and got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert (got[2].n_hit, got[2].n_items, got[2].contaminated) == (0, 0, False)


def test_rows_of_one_id_are_mixed_by_themselves(spark):
    rows = [(5, "word " * n, "s") for n in range(1, 60)] + [(6, "twice the same", "s")] * 2 + [(None, "none here", None), (None, "none there", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, copies int").repartition(3)
    taken = Counter((r.doc_id, r.source, r.text) for r in pm.repeat_documents(docs).collect())
    mixed = Counter()
    for r in pm.mix(docs).collect():
        mixed[(r.doc_id, r.source, r.size)] += r.copies
    by_size = Counter()
    for (i, s, t), n in taken.items():
        by_size[(i, s, len(t.split()))] += n
    assert by_size == +mixed and sum(len(t.split()) * n for (_, _, t), n in taken.items()) == sum(r.taken for r in pm.mix(docs).collect())


@pytest.mark.parametrize("paths", [("blob",), ("text", "blob"), ("kinds", "doc_id")])
def test_paths_with_the_ledgers_names(spark, paths):
    docs = spark.createDataFrame([(1, "p", "token = abcdef123", "q"), (2, "r", "none", "s")], "doc_id bigint, blob string, text string, kinds string")
    got = sl.find_secrets(docs, fresh_path(spark, "ledger"), paths=paths)
    assert got.columns[: len(paths)] == list(paths) and len(set(got.columns)) == len(got.columns) == len(paths) + 4 and got.count() == 2
