"""Search tables near their bound and with hot suffixes."""

import random
import time
import tracemalloc

from lacunae.llm import benchmark_decontamination as bd


def test_tables_near_the_bound_stay_small():
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(50_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=1000))) for k in range(1200)]  # about 8 MB of text, 1.2 million words
    weight = sum(len(t) + bd.WORD_BYTES * 1000 for _, t in items)
    assert weight > bd.BLOCK_BYTES / 2
    tracemalloc.start()
    (table,) = bd.tables_of(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert table.nbytes() <= weight and held < 1.5 * weight and peak < 300_000_000
    words = bd.words_of("some words before " + " ".join(items[7][1].split()[40:55]) + " and after")
    assert bd.found(words, [table]) == ([(3, 18)], {"7"})


def test_many_windows_of_one_suffix():
    tail = "of the"
    items = [(k, f"a{k} b{k} c d e f g h {tail}") for k in range(20_000)]
    tables = bd.tables_of(items)
    words = bd.words_of(" ".join(f"x{k} y c d e f g h {tail}" for k in range(2_000)) + " a77 b77 c d e f g h of the")
    began = time.perf_counter()
    spans, found = bd.found(words, tables)
    assert found == {"77"} and spans == [(20_000, 20_010)]
    assert time.perf_counter() - began < 1  # a scan of the bucket at each of 2,000 places took over 4 seconds
    same = bd.tables_of([(k, "one two three four five six seven eight nine ten") for k in range(3000)])
    assert bd.found(bd.words_of("one two three four five six seven eight nine ten"), same) == ([(0, 10)], {str(k) for k in range(3000)})


def test_windows_whose_keys_collide():
    items = [(1, "aa bb cc"), (2, "aa bb dd"), (3, "aa bb cc"), (4, "xx bb cc dd")]
    codes = {w: len(w) for _, t in items for w in bd.words_of(t)} | {b"zz": 2}  # every word has one code
    tables = [bd.WuManber(3, [(str(k), bd.words_of(t)) for k, t in items], codes)]
    for text, want in (("aa bb cc", {"1", "3"}), ("q aa bb dd", {"2"}), ("bb cc dd", {"4"}), ("zz bb cc", set())):
        assert bd.found(bd.words_of(text), tables)[1] == want
