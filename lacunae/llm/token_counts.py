"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each place of a word; dynamic programming carries, for
each place, the best score of a segmentation up to there and its number of pieces, never the segmentation itself. Ties go as in
the tokenizers library's Unigram model: candidates for a place are seen by ascending start and only a higher score replaces
one, so of equal scores the one whose last piece is longest stays. Characters that are no piece cost the least score less 10
and count as their UTF-8 bytes (byte fallback).

The vocabulary is the pieces and scores of a public SentencePiece file. Blanks are turned into its blank mark, one is put in
front, and each mark begins a word, as the library's Metaspace does. Words repeat, so counts are kept in a bounded memo.

Null and empty texts have no tokens. Repeated rows get equal results. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """All pieces with their scores, in the order of ids. Controls and byte pieces are among them and match text that spells them out,
    as in the library's Unigram model of the same vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(k), float(sp.get_score(k))) for k in range(sp.get_piece_size())]


class Counter:
    """Best score, pieces and bytes of fallback of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.memo = Memo(lambda rest: self.word(MARK + rest), 600_000)

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of a word's best segmentation."""
        n = len(word)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        at = 0  # places up to here are decided, but for single characters that are no piece
        single = [False] * (n + 1)

        def close(end: int) -> None:
            """Decide places up to end where no piece of one character ends: the unknown character comes last."""
            nonlocal at
            while at < end:
                at += 1
                if not single[at]:
                    score = best[at - 1] + self.unknown
                    if best[at] is None or score > best[at]:
                        best[at], count[at] = score, count[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))

        for last, (length, value) in self.automaton.iter(word):
            end = last + 1
            close(end - 1)
            score = best[end - length] + value
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
            if length == 1:
                single[end] = True
        close(n)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float, int]:
        """(tokens, score, words) of a whole text."""
        if not text:
            return 0, 0.0, 0
        # a blank begins the word after it; a text that begins with one gets no other in front
        parts = text.replace(" ", MARK).split(MARK)
        words = parts if parts[0] else parts[1:]
        got = [self.memo[w] for w in words]
        return sum(c for c, _ in got), sum(s for _, s in got), len(words)


def count_tokens(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, score (of the best segmentation)."""
    model = model or default_model()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        counter = shared_counter(model)

        def work(batch):
            got = [counter.text(t) for t in texts_of(batch)]
            return {"doc_id": batch.column("doc_id"), "n_tokens": [c for c, _, _ in got], "score": [s for _, s, _ in got], "n_words": [w for _, _, w in got]}

        return work

    return map_texts(base, ["doc_id", "text"], make, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint, score double")


_COUNTERS: dict[str, Counter] = {}


def shared_counter(path: str) -> Counter:
    """One counter a worker process, so that its memo serves all its tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
