"""op2: letters before combining marks, whose composition may differ by case, give the library's ids in any company."""

import sys
import unicodedata

import numpy as np
import pyarrow as pa

from lacunae.llm import token_planes as tp


def ids(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts))]


def test_every_letter_and_mark():
    own = tp.Encoder(tp.default_tokenizer())
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).lower() != chr(c).upper()]
    marks = [chr(c) for c in range(0x300, 0x370)]
    composed = [a + m for a in letters for m in marks if len(unicodedata.normalize("NFC", a + m)) != len(unicodedata.normalize("NFC", a.lower() + m)) or a.isascii()]
    texts = [*composed, *[f"x{w}y Al-{w}asan {w}." for w in composed]]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(composed) > 5000 and ids(own, texts) == want


def test_alone_and_beside_special_tokens():
    path = tp.default_tokenizer()
    library = tp.Encoder(path).tokenizer
    for text in ("J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "Al-H\u0331asan J\u030cami", "Plain WORDS, Here!", "A<|ENDOFTEXT|>b <|endoftext|> C<|x"):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(tp.Encoder(path), [text]) == [want]
        assert ids(tp.Encoder(path), ["some <|endoftext|> text", text])[1] == want
