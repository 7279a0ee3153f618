"""op4 against a plain scorer of the same model, and texts of nothing but marks, blank lines or empty words."""

import math
import re

import numpy as np
import pytest

from lacunae.llm import toxicity_mil as tm


def model():
    words, sentence, document, labels = [], [], [], []
    for d in range(200):
        toxic = d % 4 == 0
        for text in ("a plain line", "one more of them", "you idiot there" if toxic else "you there friend"):
            document.append(d)
            for w in text.split():
                words += tm.features_of(w.encode())
                sentence += [len(document) - 1] * len(tm.features_of(w.encode()))
        labels.append(int(toxic))
    return tm.train(np.array(words), np.array(sentence), np.array(document), np.array(labels))


def plain_score(own, text):
    clean = 1 - 1 / (1 + math.exp(-own.leak))
    for sentence in re.split(r"[.!?\n]", text):
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
        at = [x for w in words for x in tm.features_of(w.encode())]
        if any(own.known[x] for x in at):
            clean *= 1 - 1 / (1 + math.exp(-own.bias - sum(float(own.weights[x]) for x in at)))
    return 1 - clean


def test_like_a_plain_scorer():
    own = model()
    assert own.known.any()
    of_text = tm.scorer(own)
    for text in ("", "You idiot there. A plain line!", "a plain line\n" * 50, "idiot", "IDIOT!! idiotic? Friend. É idiot", "x" * 9000, "one. " * 400 + "idiot"):
        assert of_text(text)[0] == pytest.approx(plain_score(own, text), abs=1e-9)


def test_empty_sentences_tell_nothing():
    own = model()
    of_text = tm.scorer(own)
    nothing = of_text("")[0]
    for text in ("." * 5000, "\n \n" * 5000, "a\n\n" * 2000, "...?!", "unseen words only. " * 3000):
        assert of_text(text)[0] == nothing < 0.3 and of_text(text)[4] == []
    score, n, worst, _, bad = of_text("...\n\nyou idiot there\n...")
    assert score > 0.3 and worst == 5 and bad == [5] and n == 10
