"""Periodic runs of words by seeds that are extended along diagonals.

A run is a stretch with smallest period q and a length of at least max(6, 4q), as long as it can be. Its words equal those q
further on, over at least max(6, 4q) - q words: that overlap is a stretch of the diagonal of lag q. So the windows of k words, k
the least such overlap of a class of periods, are indexed; each window and its next occurrence in the same text are a pair, whose
distance is the lag; each pair seeds an extension to both sides along its diagonal; and for each lag a table says how far the
diagonal is covered, so that the other pairs of a stretch extend nothing again.

Classes are lo..k for k = max(6, 4 lo) - lo (1..5, 6..18, 19..57, ...), so k is at least q. Then the next occurrence is enough, and no
pair of later ones is needed: were a window of a run repeated at a distance r < q, the stretch from it to that repeat's end would
have both periods over at least q + r words, so the run would have the period gcd(q, r). And a pair of next occurrences never has a
smaller period inside. Windows are named exactly, by doubling; only those that repeat in their text are looked at again. A batch
of texts is searched at once. Runs of a text take time in proportion to n log n (all runs of one class cover a text a bounded number of times).

Null texts have no words. Rows are judged one by one: repeated rows get equal results, whatever their ids. Very long texts are
searched whole: memory is some hundred bytes a word of one batch. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of
from .substring_dedup import words_of

LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def classes(n: int, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """(smallest, largest period) of each class that a text of n words can hold. The largest is also the length of the class's windows."""
    out, lo = [], 1
    while max(length, exponent * lo) <= n:
        k = max(length, exponent * lo) - lo
        out.append((lo, k))
        lo = k + 1
    return out


def _names(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of windows by their keys, at these places of n; -1 elsewhere and where a key occurs once."""
    out = np.full(n, -1)
    if len(keys):
        _, name, many = np.unique(keys, return_inverse=True, return_counts=True)
        out[at] = np.where(many[name] > 1, name, -1)
    return out


def _joined(names: np.ndarray, shift: int) -> np.ndarray:
    """Names of longer windows: of each place and the one `shift` further on."""
    ahead = names[shift:]
    at = np.flatnonzero((names[: len(ahead)] >= 0) & (ahead >= 0))
    return _names(names[at] * len(names) + ahead[at], at, len(names))


def _extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """Where the stretch of the diagonal that holds this place begins and ends. It ends at a text's end, whose mark equals nothing."""
    first, step = at, 16
    while True:
        low = max(0, first - step)
        differ = np.flatnonzero(words[low:first] != words[low + lag : first + lag])
        first = low + int(differ[-1]) + 1 if len(differ) else low
        if len(differ) or not low:
            break
        step *= 2
    end, step = at, 16
    while True:
        ahead = words[end + lag : end + lag + step]
        differ = np.flatnonzero(words[end : end + len(ahead)] != ahead)
        if len(differ) or len(ahead) < step:
            return first, end + (int(differ[0]) if len(differ) else len(ahead))
        end, step = end + step, step * 2


def runs_of(words: np.ndarray, text: np.ndarray, length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs, by start and period. words: numbers of the words of many texts, each text ended by a mark of its
    own that occurs nowhere else; text: the text's number at each place."""
    n, found = len(words), []
    known = words >= 0
    place = np.flatnonzero(known)
    _, dense = np.unique(words[place], return_inverse=True)
    names, have = _names(text[place] * (n + 1) + dense, place, n), 1
    for lo, k in classes(int(np.bincount(text).max(initial=1)) - 1, length, exponent):
        while 2 * have < k and (names >= 0).any():
            names, have = _joined(names, have), 2 * have
        if have < k:
            names, have = _joined(names, k - have), k
        at = np.flatnonzero(names >= 0)
        if not len(at):
            break
        at = at[np.argsort(names[at], kind="stable")]
        lag = np.where(names[at[1:]] == names[at[:-1]], at[1:] - at[:-1], 0)
        pair = (lag >= lo) & (lag <= k)
        lag, at = lag[pair], at[:-1][pair]
        order = np.lexsort((at, lag))
        lag, at = lag[order], at[order]
        fresh = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]  # the others follow a pair of the same stretch
        covered: dict[int, int] = {}
        for q, i in zip(lag[fresh].tolist(), at[fresh].tolist(), strict=True):
            if i >= covered.get(q, 0):
                first, covered[q] = _extended(words, i, q)
                if covered[q] - first + q >= max(length, exponent * q):
                    found.append((first, covered[q] - first + q, q))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period), collapsed: the words left, joined by blanks, where of each
    run only the first period stays."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def make():
        def work(batch):
            texts = [words_of(t) for t in texts_of(batch)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            numbers: dict[bytes, int] = {}
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in (*t, b"")), np.int64)
            ends = np.cumsum(sizes + 1)
            flat[ends - 1] = -1 - np.arange(len(ends))
            runs = runs_of(flat, np.repeat(np.arange(len(texts)), sizes + 1), length, exponent)
            owner = np.searchsorted(ends, runs[:, 0], "right")
            begins = ends - sizes - 1
            gone = np.zeros(len(flat) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            gone = np.cumsum(gone) > 0
            runs[:, 0] -= begins[owner]
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            kept = []
            for words, (a, b), at in zip(texts, pairwise(bounds.tolist()), begins.tolist(), strict=True):
                if b > a:
                    words = [w for w, drop in zip(words, gone[at : at + len(words)].tolist(), strict=True) if not drop]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            each = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"])
            return {"doc_id": batch.column("doc_id"), "n_words": sizes, "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each), "collapsed": kept}

        return work

    return map_texts(base, ["doc_id", "text"], make, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: where h, the unsigned crc32 of the decimal doc_id, is a multiple of 10, the words from a place on repeat with a period.
    Rows without an id and texts without words stay as they are."""
    n, g = F.size("w"), F.expr("h div 10")
    a, p = F.expr("g % n"), F.expr("1 + (n - a) div (3 + g % 8)")
    hit = docs.select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.expr("h % 10 = 0"), F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    hit = hit.withColumn("w", words).withColumn("n", n).withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return hit.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    got = find_runs(with_repeats(docs)).withColumn("best", F.when(F.size("runs") > 0, best))
    told = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return got.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: crc32 of a decimal number, byte by byte and bit by bit; 3988292384 is the polynomial.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}::VARCHAR) + 1), lambda k: ascii(({0}::VARCHAR)[k])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32.format("doc_id")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w
  FROM e),
five AS (SELECT doc_id, i, w[i + 1:i + 5] AS f FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM t)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM five x JOIN five y ON x.doc_id = y.doc_id AND x.f = y.f AND y.i > x.i),
isles AS (
  SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs)
  GROUP BY doc_id, q, isle),
enough AS (SELECT * FROM isles WHERE len >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM enough x WHERE NOT EXISTS (FROM enough y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)),
best AS (SELECT doc_id, s, len, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) AS nth FROM runs) WHERE nth = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM t) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, len::BIGINT AS length, q::BIGINT AS period, (1000 * len // q)::BIGINT AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
