"""op11 against a plain trie: long conversations, ties, nulls, heavy keys and many levels of the recursion."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lacunae.llm import prefix_trie as pt
from lacunae.llm.registry import REGISTRY


def slow(table):
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).digest()[:16], role or "", text or ""))
    turns = {c: [(r[3], r[4]) for r in sorted(rows)] for c, rows in own.items()}
    whole = {c: turns.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + turns[c][zlib.crc32(str(c).encode()) % 4 :] for c in turns}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1].encode().split())
            up = node[:-1]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    out = set()
    for node, m in members.items():
        ends = ",".join(str(c) for c in m if len(whole[c]) == len(node))
        out.add((m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(n=160, deepest=9, seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        if c % 20 == 0 and c % 3 == 0:
            continue  # absent
        for t in range(rng.choice((1, 2, 3, deepest))):
            text = "the same start" if t == 0 and c % 2 else rng.choice(("yes", "no way", "a b c", None, ""))
            out.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(("user", None)) if c % 7 == 0 else "user", text))
    out += [(200 + c, t, "user", f"turn {t}" if t % 40 or c < 3 else f"other {c}") for c in range(6) for t in range(150)]
    out += [(13, 1, "user", "tie"), (13, 1, "assistant", "tie"), (13, 1, "assistant", "tie"), (None, 0, "user", "no conversation"), (-40, 0, "user", "before zero")]
    rng.shuffle(out)
    return out


def query(spark, folder, made):
    spark.createDataFrame([(*r, 1, 2, "x") for r in made], "conv_id bigint, turn bigint, role string, text string, pos int, seq bigint, node string").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    got = REGISTRY["op11_prefix_trie"][0](spark, str(folder))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("chunk, heavy", [(64, 1000), (4, 20)])
def test_like_a_plain_trie(spark, tmp_path, monkeypatch, chunk, heavy):
    monkeypatch.setattr(pt, "CHUNK", chunk)
    monkeypatch.setattr(pt, "HEAVY", heavy)
    made = table()
    assert query(spark, tmp_path, made) == slow(made)


def test_of_turnless_conversations_only(spark, tmp_path):
    made = [(c, 0, "user", "gone") for c in range(1, 8) if zlib.crc32(str(c).encode()) % 4]
    assert len(made) > 2 and query(spark, tmp_path, made) == slow(made)


def test_lists_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 100)
    rows = [(b"k" if k % 3 else b"l", k) for k in range(-50, 3000)]
    got = {bytes(r.node): r.sha256 for r in pt.listed_sha256(spark.createDataFrame(rows, "node binary, seq bigint").repartition(7)).collect()}
    assert got == {key: hashlib.sha256(",".join(str(v) for k, v in sorted(rows) if k == key).encode()).hexdigest() for key in (b"k", b"l")}


def test_numbering_over_ranges(spark):
    rows = [(1, k % 500, k.to_bytes(4, "big")) for k in range(4000)] + [(s, 0, b"x") for s in range(2, 50)]
    got = pt.numbered(spark.createDataFrame(rows, "seq bigint, turn bigint, item binary").repartition(6), "seq", ["turn", "item"]).collect()
    for seq in range(1, 50):
        own = sorted((r.turn, bytes(r.item)) for r in got if r.seq == seq)
        assert sorted((r.pos, r.turn, bytes(r.item)) for r in got if r.seq == seq) == [(k, *x) for k, x in enumerate(own)]
