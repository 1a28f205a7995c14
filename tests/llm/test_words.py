"""Word rules and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa

from strandline.llm import textops

TEXTS = ["", "a", "  Aa bB\tc\x0b\x0c ", "é É ß x", "x" * 5000, "a b " * 300, "\n"]


def test_words_of_every_text():
    column = pa.array([t.encode() for t in TEXTS], pa.binary())
    got = []
    for lo, hi, offsets, data in textops.chunks(column, most=64):
        w = textops.words_of(offsets, data)
        base = data.tobytes()
        got += [(lo + d, base[s:e]) for d, s, e in zip(w.doc, w.start, w.end, strict=True)]
    want = [(k, m.encode()) for k, t in enumerate(TEXTS) for m in re.findall(textops.SPACED_WORD, t)]
    assert got == want


def test_equal_words_have_equal_hashes_in_any_run():
    def hashes(texts):
        column = pa.array([t.encode() for t in texts], pa.binary())
        return {(w.data[s:e].tobytes(), int(h)) for _, _, o, d in textops.chunks(column) for w in [textops.words_of(o, d)] for s, e, h in zip(w.start, w.end, w.hash, strict=True)}

    assert hashes(["Hello world"]) <= hashes(["x", "", "world HELLO hello"])
    assert len({h for _, h in hashes(["ab ba aab aba baa a b aa bb"])}) == 9


def test_grams_depend_on_order():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    g = textops.grams(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 5 and len(textops.grams(h[:2], 3)) == 0
