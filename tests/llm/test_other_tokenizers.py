"""Tokenizers whose file doesn't allow the word-by-word shortcut go through the library whole."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest

from lacunae.llm import token_planes as tp

TEXTS = ["Hello World, this is", "", None, "  two  blanks\tand\nlines ", "ÜBER ß 日本語 🙂", "it's DON'T <|endoftext|> x"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_librarys(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.ids) for r in tp.encode_corpus(docs, tokenizer=path).collect()}
    for k, text in enumerate(TEXTS):
        assert np.frombuffer(got[k], "<u4").tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert tp.by_words(json.load(open(path, encoding="utf-8"))) == (name == "word_bpe_49k.json")


def test_shortcut_needs_the_whole_file_to_be_as_expected():
    file = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 5}), ("added_tokens", [{"content": "the"}])):
        assert not tp.by_words(file | {key: value})


def test_one_id_with_many_texts_is_dealt_by_text(spark):
    docs = spark.createDataFrame([(7, f"text number {k}") for k in range(400)], "doc_id bigint, text string")
    got = tp.encode_corpus(docs)
    assert got.count() == 400
    rows = sorted(got.collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in rows)
