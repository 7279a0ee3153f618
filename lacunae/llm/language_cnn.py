"""Language identification with a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length. Bytes have embeddings (tied within 64 classes: both cases of a
letter share one, as do digits and marks), filters of several widths run over them, each filter's maximum in the window is
kept, and a softmax layer tells the language. The network is trained on a bounded sample of windows of labelled documents.
For prediction, filters are folded into tables over pairs of byte classes, so a filter's value at a place is a sum of looked-up
rows. A document's probabilities are the mean of its windows', weighted by their lengths.

A text that is null or has no letter is `und` with score 0. With nothing to learn from, every text is `und`. Repeated rows get
equal results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, small_batches, texts_of

STRIDE = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
CLASSES = 64
PAD = 27
#: Bound on the labelled documents that are learned from, in expectation for each language; of each, WINDOWS windows.
PER_LANGUAGE = 800
WINDOWS = 2
UNDETERMINED = "und"


def _class(b: int) -> int:
    c = b | 32
    if 97 <= c <= 122 and b < 128:
        return c - 97
    if b < 128:
        return PAD if b in b" \t\n\r\f\v" else 26
    if b < 192:
        return 32 + (b & 31)
    return 28 if b < 196 else 29 if b < 224 else 30 if b < 240 else 31


_TO_CLASS = bytes(_class(b) for b in range(256))


def classes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TO_CLASS), np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # classes x EMBEDDING
    filters: list[np.ndarray]  # for each width: width * EMBEDDING x FILTERS
    bias: np.ndarray  # widths * FILTERS
    dense: np.ndarray  # widths * FILTERS x languages
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, tables over class pairs (and single classes at last) whose rows sum to the filters' values."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            own = [self.embedding @ f[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)]
            pairs = [(own[k][:, None] + own[k + 1][None]).reshape(-1, FILTERS) for k in range(0, w - 1, 2)]
            out.append([np.ascontiguousarray(x, np.float32) for x in pairs + own[w - 1 :] * (w % 2)])
        return out

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.offset
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class Predictor:
    """Whole texts to probabilities, many windows at once."""

    def __init__(self, network: Network, windows_at_once: int = 128):
        self.network, self.tables, self.at_once = network, network.tables(), windows_at_once

    def pooled(self, grams: list[np.ndarray]) -> np.ndarray:
        """Filters' maxima for windows of STRIDE places; grams[k]: the class k places on."""
        pair = [(grams[k].astype(np.int64) << 6) | grams[k + 1] for k in range(max(WIDTHS) - 1)]
        out = []
        for w, tables in zip(WIDTHS, self.tables, strict=True):
            value = tables[0][pair[0]]
            for k, table in enumerate(tables[1:], 1):
                value += table[pair[2 * k]] if 2 * k + 1 < w else table[grams[2 * k]]
            value = value.reshape(-1, STRIDE, FILTERS)
            n = STRIDE
            while n > 1:  # halves against each other: long vectors for numpy
                n //= 2
                value = np.maximum(value[:, :n], value[:, n : 2 * n])
            out.append(value[:, 0])
        return np.concatenate(out, axis=1)

    def predict(self, texts: list[str]) -> np.ndarray:
        """One row of probabilities a text; windows take in the bytes after them that a filter needs, padded at the text's end."""
        parts = [classes_of(t) for t in texts]
        counts = np.array([max(1, -(-len(p) // STRIDE)) for p in parts])
        c = np.full(int(counts.sum()) * STRIDE, PAD, np.uint8)
        first = (np.cumsum(counts) - counts) * STRIDE
        for p, at in zip(parts, first, strict=True):
            c[at : at + len(p)] = p
        grams, last = [c], first + counts * STRIDE - 1
        for _ in range(max(WIDTHS) - 1):
            nxt = np.append(grams[-1][1:], np.uint8(PAD))
            nxt[last] = PAD
            grams.append(nxt)
        step = self.at_once * STRIDE
        p = np.concatenate([self.network.probabilities(self.pooled([g[k : k + step] for g in grams])) for k in range(0, len(c), step)])
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        weight = np.clip(np.array([len(x) for x in parts])[owner] - nth * STRIDE, 1, STRIDE).astype(float)
        total = np.add.reduceat(p * weight[:, None], np.cumsum(counts) - counts, axis=0)
        return total / np.add.reduceat(weight, np.cumsum(counts) - counts)[:, None]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on cross-entropy; windows are rows of STRIDE + max(WIDTHS) - 1 byte classes. Classes are weighed evenly."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), len(WIDTHS) * FILTERS
    net = Network(
        languages,
        rng.normal(0, 0.5, (CLASSES, EMBEDDING)),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(f), rng.normal(0, (2 / f) ** 0.5, (f, k)), np.zeros(k),
    )
    params = [net.embedding, *net.filters, net.bias, net.dense, net.offset]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weights = len(labels) / (k * np.maximum(1, np.bincount(labels, minlength=k)))
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            c, y = windows[rows], labels[rows]
            n, x = len(rows), net.embedding[windows[rows]]
            pooled, where = np.empty((n, f)), []
            for i, w in enumerate(WIDTHS):
                view = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), w * EMBEDDING, axis=1)[:, : STRIDE * EMBEDDING : EMBEDDING]
                conv = view.reshape(n * STRIDE, -1) @ net.filters[i]
                conv = conv.reshape(n, STRIDE, FILTERS)
                where.append(conv.argmax(axis=1))
                pooled[:, i * FILTERS : (i + 1) * FILTERS] = np.take_along_axis(conv, where[-1][:, None], axis=1)[:, 0]
            active = pooled + net.bias > 0
            hidden = np.where(active, pooled + net.bias, 0)
            p = net.probabilities(pooled)
            d = p.copy()
            d[np.arange(n), y] -= 1
            d *= (weights[y] / n)[:, None]
            d_pool = (d @ net.dense.T) * active
            g_embedding, g_filters = np.zeros_like(net.embedding), []
            for i, w in enumerate(WIDTHS):
                at = where[i][:, :, None] + np.arange(w)
                own = c[np.arange(n)[:, None, None], at]  # n x FILTERS x w classes under each filter's maximum
                e = net.embedding[own].reshape(n, FILTERS, -1)
                dp = d_pool[:, i * FILTERS : (i + 1) * FILTERS]
                g_filters.append(np.einsum("nf,nfk->kf", dp, e))
                back = (dp[:, :, None] * net.filters[i].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                np.add.at(g_embedding, own, back)
            grads = [g_embedding, *g_filters, d_pool.sum(axis=0), hidden.T @ d + 1e-4 * net.dense, d.sum(axis=0)]
            t += 1
            for q, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, windows: int = WINDOWS, seed: int = 7) -> Network | None:
    """Train on text and lang of documents that are not held out.

    About per_language documents of each language are chosen by a hash of their ids, and of each text windows at hashed places
    come to the driver, which so holds at most languages * per_language * windows rows of 259 bytes (in expectation).
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    known = known.where(~held_out("doc_id", 3, 1))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    rates = counts.select(F.col("lang").alias("_l"), (F.lit(float(per_language)) / F.col("n")).alias("rate"))
    chosen = known.join(F.broadcast(rates), F.col("lang") == F.col("_l")).where(part < F.col("rate"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id", F.lit(seed + 1)))
    length = STRIDE + max(WIDTHS) - 1
    small_batches(spark)

    def make():
        def work(batch):
            langs, hs, rows = [], [], []
            for text, lang, h in zip(texts_of(batch), batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True):
                c = classes_of(text)
                if has_letter(text):
                    for k in range(windows if len(c) > length else 1):
                        at = (h + k * 0x9E3779B97F4A7C15) % max(1, len(c) - length + 1)
                        langs.append(lang), hs.append(h), rows.append(c[at : at + length].tobytes().ljust(length, bytes([PAD])))
            return {"lang": langs, "h": hs, "window": rows}

        return work

    got = map_texts(chosen, ["text", "lang", "h"], make, "lang string, h bigint, window binary").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return None
    data = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, length)
    return train(data, np.searchsorted(languages, got["lang"].to_pylist()), languages, seed=seed)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        predictor = _predictor(own)

        def work(batch):
            langs, scores = _identified(predictor, batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "lang_pred": langs, "score": scores}

        return work

    return map_texts(base, ["doc_id", "text"], make, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def _predictor(network) -> Predictor | None:
    return Predictor(network.value) if network.value else None


def _identified(predictor: Predictor | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t and has_letter(t)] if predictor else []
    for s in range(0, len(known), 64):
        own = known[s : s + 64]
        p = predictor.predict([texts[k] for k in own])
        for k, best, score in zip(own, p.argmax(axis=1), p.max(axis=1), strict=True):
            langs[k], scores[k] = predictor.network.languages[best], min(1.0, float(score))
    return langs, scores


def keep_identified(docs: DataFrame, network: Network | None, min_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose language the network can tell: not `und`, with at least min_score."""
    own = docs.sparkSession.sparkContext.broadcast(network)
    small_batches(docs.sparkSession)

    def clean(batches):
        predictor = _predictor(own)
        for batch in batches:
            langs, scores = _identified(predictor, batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op7_language_cnn(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flags = docs.select(F.col("doc_id"), "text")
    got = identify(flags, fit(docs))
    return got.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
