"""Toxicity by multiple-instance learning.

Labels mark whole documents, though a few sentences make them toxic. A sentence's score is a logistic function of its words and
their beginnings; a document's is the noisy-or of its sentences', 1 - prod(1 - p). The gradient of the documents' likelihood so
reaches the sentences, and the trained words score each sentence of any document: those with the highest scores are where it
offends.

Labels are noisy: some documents are marked though none of their sentences offends. A leak, one more term of the noisy-or that
every document has, takes up their share, so that long clean documents aren't made suspects. Only words that toxic documents
hold significantly more often than others have a weight (MIN_DOCS, MIN_Z); rare words would only learn the noise by heart. A sentence
without such a word tells nothing: it has no term in the noisy-or, in training as in scoring, so neither many sentences nor blank lines
and rows of dots raise a score.

Words are hashed to FEATURES places. Null and empty texts score as all texts without such words, by the leak alone. Repeated rows
get equal results; of several texts of a labelled doc_id the least in order is learned from. Of several labels of a document any
toxic one counts. Without labelled rows every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, held_out, map_texts, texts_of

FEATURES = 1 << 18
THRESHOLD = 0.3
#: Bounds on the labelled documents that are learned from: their number, and the bytes of each. The driver so holds the features
#: of SAMPLE * SAMPLE_BYTES bytes of text at the most, whatever the corpus.
SAMPLE = 5_000
SAMPLE_BYTES = 32_768
#: Lengths in bytes of the beginnings of words that count besides the words.
PREFIXES = (3, 5)
MIN_DOCS = 20
MIN_Z = 5.0
L2 = 1e-4

#: Lower case; sentence ends become line ends, other marks and controls blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".!?\n" else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def sentences_of(text: str | None) -> list[list[bytes]]:
    """Words of each sentence; non-ASCII letters keep their case."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    return [s.split() for s in data.split(b"\n")]


def features_of(word: bytes) -> list[int]:
    """Places of the word and of its beginnings: inflected and compound forms share those."""
    return [zlib.crc32(x) % FEATURES for x in (word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k))]


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), without losing small probabilities."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


@dataclass
class Model:
    weights: np.ndarray  # of each feature
    known: np.ndarray  # whether a feature is screened
    bias: float  # of a sentence with a screened feature
    leak: float  # logit of a document without offending sentences


def screened(words: np.ndarray, document_of_word: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Features of at least MIN_DOCS documents that toxic ones hold more often than the others by MIN_Z standard errors.

    Words stand in the order of their documents.
    """
    df = np.zeros((2, FEATURES), np.int32)
    bounds = np.searchsorted(document_of_word, np.arange(len(labels) + 1))
    for label, a, b in zip(labels, bounds, bounds[1:]):
        df[int(label == 1), np.unique(words[a:b])] += 1
    n1 = max(1, int((labels == 1).sum()))
    n0 = max(1, len(labels) - n1)
    p = df.sum(axis=0) / len(labels)
    error = np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))
    return np.flatnonzero((df.sum(axis=0) >= MIN_DOCS) & ((df[1] / n1 - df[0] / n0) / error >= MIN_Z))


def train(words: np.ndarray, sentence: np.ndarray, document: np.ndarray, labels: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = L2) -> Model:
    """Leaky noisy-or by Adam. words: features in turn; sentence: of each word; document: of each sentence."""
    n_d = len(labels)
    known = screened(words, document[sentence], labels)
    place = np.full(FEATURES, -1)
    place[known] = np.arange(len(known))
    x = place[words]
    x, s = x[x >= 0], sentence[x >= 0]
    told, s = np.unique(s, return_inverse=True)  # sentences with screened words
    owner = document[told]
    theta = np.concatenate([np.ones(len(known)), [-6.0, -3.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        w, bias, leak = theta[:-2], theta[-2], theta[-1]
        z = np.bincount(s, w[x], len(told)) + bias
        none = np.exp(-np.bincount(owner, np.logaddexp(0, z), n_d) - np.logaddexp(0, leak))
        pull = np.where(labels == 1, -none / np.maximum(1 - none, 1e-9), 1.0) / n_d
        g = pull[owner] * sigmoid(z)
        grad = np.concatenate([np.bincount(x, g[s], len(known)) + l2 * w, [g.sum(), pull.sum() * sigmoid(leak)]])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    out = np.zeros(FEATURES, np.float32)
    out[known] = theta[:-2]
    return Model(out, np.isin(np.arange(FEATURES), known), float(theta[-2]), float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, seed: int = 11) -> Model | None:
    """Train on labelled documents that are not held out: at most `sample` of them are chosen by a hash of their ids, and those of them learned
    from that have at most `sample_bytes` of text."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id", 4, 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = base.where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def make():
        features = Memo(features_of)

        def work(batch):
            words, ends = [], []
            for text in texts_of(batch):
                sentences = [s for s in sentences_of(text) if s]
                of_sentence = [[x for w in s for x in features[w]] for s in sentences]
                words.append(np.array([x for s in of_sentence for x in s], "<u4").tobytes())
                ends.append(np.array(list(map(len, of_sentence)), "<u4").tobytes())
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": words, "lengths": ends}

        return work

    got = map_texts(chosen, ["doc_id", "text", "toxic"], make, "doc_id bigint, toxic int, words binary, lengths binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("words", "ascending")])
    if not got.num_rows:
        return None
    lengths = [np.frombuffer(x, "<u4") for x in got["lengths"].to_pylist()]
    words = np.frombuffer(b"".join(got["words"].to_pylist()), "<u4")
    document = np.repeat(np.arange(len(lengths), dtype=np.int32), [len(x) for x in lengths])
    sentence = np.repeat(np.arange(len(document), dtype=np.int32), np.concatenate(lengths))
    return train(words, sentence, document, got["toxic"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence (its place), worst_score, worst_start, worst_end (code points), and offending: the
    spans (starts and ends in turn) of all sentences that reach the threshold by themselves."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of_text = scorer(own.value)

        def work(batch):
            texts = texts_of(batch)
            rows = [of_text(t) for t in texts]
            spans = [_spans(t, [k, *bad]) for t, (_, _, k, _, bad) in zip(texts, rows, strict=True)]
            names = ("score", "n_sentences", "worst_sentence", "worst_score")
            told = {"worst_start": [s[0][0] for s in spans], "worst_end": [s[0][1] for s in spans], "offending": [[x for pair in s[1:] for x in pair] for s in spans]}
            return {"doc_id": batch.column("doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)} | told

        return work

    kind = base.schema["doc_id"].dataType.simpleString()
    return map_texts(base, ["doc_id", "text"], make, f"doc_id {kind}, score double, n_sentences bigint, worst_sentence bigint, worst_score double, worst_start bigint, worst_end bigint, offending array<bigint>")


def _spans(text: str, places: list[int]) -> list[tuple[int, int]]:
    """Code-point spans of the sentences at these places."""
    wanted, flat, out, start = set(places), text.translate(_ENDS), {}, 0
    for nth in range(max(places) + 1):
        end = flat.find("\n", start)
        end = len(text) if end < 0 else end
        if nth in wanted:
            out[nth] = (start, end)
        start = end + 1
    return [out[k] for k in places]


_ENDS = str.maketrans(".!?", "\n\n\n")


def scorer(model: Model | None, threshold: float = THRESHOLD) -> Callable[[str], tuple[float, int, int, float, list[int]]]:
    """text -> score, sentences, place and score of the worst, places of those that reach the threshold."""
    if model is None:
        return lambda text: (0.0, len(sentences_of(text)), 0, 0.0, [])
    least = float(np.log(threshold / (1 - threshold)))

    def weight_of(word: bytes) -> float | None:
        at = features_of(word)
        return float(model.weights[at].sum()) if model.known[at].any() else None

    weight = Memo(weight_of).__getitem__

    def of_text(text: str) -> tuple[float, int, int, float, list[int]]:
        sentences = sentences_of(text)
        told, z = [], []
        for place, sentence in enumerate(sentences):
            if own := [x for x in map(weight, sentence) if x is not None]:
                told.append(place), z.append(sum(own) + model.bias)
        z = np.array(z)
        worst = int(z.argmax()) if told else None
        bad = [told[k] for k in np.flatnonzero(z >= least)]
        chance = float(1 / (1 + np.exp(-z[worst]))) if told else 0.0
        return noisy_or(np.append(z, model.leak)), len(sentences), told[worst] if told else 0, chance, bad

    return of_text


def op4_toxicity_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model)
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", predicted, "worst_start", "worst_end", "offending")
