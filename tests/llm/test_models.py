"""Learned operators: accuracy on held-out rows, exactness of their recursions, odd rows."""

import itertools
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import langid, lattice, toxicity

ODD = [(9001, None), (9002, ""), (9003, "1234 !!"), (9004, "\n\t"), (None, "some words without an id"), (9005, "z" * 40000), (9006, "ab " * 9000), (1, "repeated id"), (1, "repeated id")]
CONSONANTS, VOWELS = "bdfgklmnprst", "aeiou"


def language(rng, k):
    words = ["".join(rng.choice(CONSONANTS[k * 3 : k * 3 + 6]) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    return lambda n: " ".join(rng.choices(words, k=n))


def test_language_by_compression(spark):
    rng = random.Random(0)
    makers = {f"l{k}": language(rng, k) for k in range(3)}
    rows = [(k, makers[lang](rng.randint(5, 80)).title(), lang if k % 9 else None, "u") for k in range(400) for lang in [f"l{k % 3}"]]
    docs = spark.createDataFrame(rows + [(i, t, None, "u") for i, t in ODD], "doc_id long, text string, lang string, lang_pred string")
    got = langid.predicted(docs).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.lang_pred == f"l{r.doc_id % 3}" for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003, 9004)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() >= 0.97 * 400
    assert kept.where("doc_id in (9001, 9002, 9003, 9004)").count() == 0
    none = docs.where("false")
    assert langid.predicted(none).count() == 0 and {r.lang_pred for r in langid.predicted(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


SCORES = {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -1.0, "▁a": -1.2, "▁ab": -0.9, "ba": -2.2} | {f"\0{k:02x}": -6.0 for k in range(256)}


def brute(word):
    """Sum over all segmentations, by listing them."""
    text, total = "▁" + word, []
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, last = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(text[last:k])
                last = k
        parts.append(text[last:])
        score = 0.0
        for p in parts:
            if p in SCORES:
                score += SCORES[p]
            elif len(p) == 1:
                score += -6.0 * len(p.encode())
            else:
                score = -math.inf
                break
        total.append(score)
    return math.log(sum(math.exp(t) for t in total))


@pytest.mark.parametrize("word", ["a", "ab", "abab", "bbaab", "aéb", "x"])
def test_forward_recursion_sums_all_segmentations(word):
    own = lattice.Lattice(SCORES)
    assert abs(own.log_probability(word) - brute(word)) < 1e-9
    counts = {}
    own.expected(word, 2.0, counts)
    pieces = sum(v * (len(p) if p[0] != "\0" else 0) for p, v in counts.items())
    known = sum(2.0 for c in "▁" + word if c in own.chars)
    assert abs(pieces - known) < 1e-9


def by_pieces(word, scores):
    """Sum over segmentations by recursion on the first piece, without a lattice."""
    from functools import cache

    @cache
    def rest(text):
        if not text:
            return 1.0
        total = sum(math.exp(scores[text[:k]]) * rest(text[k:]) for k in range(1, len(text) + 1) if text[:k] in scores)
        if text[0] not in scores:
            total += math.exp(sum(scores[f"\0{b:02x}"] for b in text[0].encode())) * rest(text[1:])
        return total

    return math.log(rest("▁" + word))


@pytest.mark.skipif(not os.path.exists(lattice.VOCABULARY), reason="no vocabulary file")
def test_text_scores_equal_brute_force(spark):
    """Expected counts of one round and text scores from listed segmentations alone."""
    rng = random.Random(4)
    words = ["the", "of", "ab", "é", "no", "zq7"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for k in range(30)]
    first = lattice.vocabulary()
    train = [t.split() for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    counts, seen = Counter(w for t in train for w in t), Counter()

    def cuts(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            own = [text[:k]] if text[:k] in first else [f"\0{b:02x}" for b in text[0].encode()] if k == 1 else None
            if own:
                for more, s in cuts(text[k:]):
                    yield (*own, *more), s + sum(first[p] for p in own)

    for w, c in counts.items():
        every = list(cuts("▁" + w))
        total = sum(math.exp(s) for _, s in every)
        for pieces, s in every:
            for p in pieces:
                seen[p] += c * math.exp(s) / total
    whole, prior = sum(seen.values()), max(1.0, lattice.SMOOTH * len(first))
    scores = {p: math.log((seen[p] + prior * math.exp(s)) / (whole + prior)) for p, s in first.items()}
    end = (len(train) + 0.5) / (sum(map(len, train)) + len(train) + 1)
    got = {r.doc_id: r.score for r in lattice.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        want = sum(by_pieces(w, scores) for w in t.split()) + len(t.split()) * math.log1p(-end) + math.log(end)
        assert abs(got[k] - want / math.log(10)) < 1e-6


@pytest.mark.skipif(not os.path.exists(lattice.VOCABULARY), reason="no vocabulary file")
@pytest.mark.parametrize("hot", [lattice.HOT, 3])
def test_scores_equal_plain_python(spark, hot):
    rng = random.Random(1)
    words = ["the", "of", "Lattice", "é", "über", "zq7x"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)) + [f"rare{k}"] * (k % 2)), 0) for k in range(60)] + [(i, t, 0) for i, t in ODD]
    got = lattice.scored(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), hot=hot).collect()
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    rest = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter()
    texts = 0
    for i, t, _ in rows:
        if rest(i) != 1:
            c.update(fold(t))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    base = lambda x: math.log10((x + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(i), rest(i) == 1, len(fold(t)) + 1, sum(c[w] > 0 for w in fold(t)) + 1, n, round(sum(base(c[w]) for w in fold(t)) + base(texts), 6)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by_text.values())


def test_lattice_on_empty_table(spark):
    if os.path.exists(lattice.VOCABULARY):
        assert lattice.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field({}, 0.0, rng.standard_normal((2, 2)))
    rows = [rng.standard_normal(n) for n in (5, 1, 3, 0, 4)]
    for e, p in zip(rows, field.marginals(rows), strict=True):
        total, one = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            w = math.exp(sum(e[k] for k in range(len(e)) if y[k]) + sum(field.step[y[k], y[k + 1]] for k in range(len(e) - 1)))
            total += w
            one += w * np.array(y)
        assert np.allclose(p, one / total) if len(e) else len(p) == 0


@pytest.mark.parametrize("text", ["good day\u00a0vile x", "a\u3000b c", "\u0085 x", "", "--", "İx é-ö", "tab\tand\x1fsep"])
def test_tokens_stand_where_spans_say(text):
    spans = [m.span() for m in toxicity.TOKEN.finditer(text)]
    assert toxicity.tokens(text.encode()) == [text[a:b].lower() for a, b in spans]


def test_windows_cover_whole_texts():
    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(1000))
    b = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([1, 0], pa.int32()), pa.array([text.encode(), b""])], ["uid", "toxic", "text"])
    rows = [r for x in toxicity._windows(iter([b])) for r in x.to_pylist()]
    assert [w for r in rows for w in r["words"]] == text.split() and {r["uid"] for r in rows} == {7}
    assert all(len(r["words"]) <= toxicity.WINDOW for r in rows)


def test_document_scores_equal_enumeration(spark):
    """The score of a text from the learned field: all label sequences, their marginals, then the calibration."""
    rng = random.Random(8)
    plain, bad = [f"w{k}o" for k in range(80)], ["vile", "rottenthing"]
    rows = [(k, " ".join(rng.choices(plain, k=rng.randint(1, 7)) + rng.choices(bad, k=2 * (k % 3 == 0)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    field, w = toxicity.learned(docs, marks)
    assert field.weights
    text = dict(rows)
    for r in toxicity.toxicity(docs, marks).where("doc_id < 60").collect():
        e = field.emissions(toxicity.tokens(text[r.doc_id].encode()), {})
        total, one = 0.0, np.zeros(len(e))
        for y in itertools.product((0, 1), repeat=len(e)):
            p = math.exp(sum(x for x, s in zip(e, y, strict=True) if s) + sum(field.step[a, b] for a, b in itertools.pairwise(y)))
            total, one = total + p, one + p * np.array(y)
        p = one / total
        z = w @ [1.0, math.log(p.sum() + 0.05), math.log((p.sum() + 0.05) / (len(p) + 20)), p.max()]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_labels_beyond_the_bit_sets(spark, monkeypatch):
    rows = [(k, ("vile " if k % 2 else "kind ") + f"w{k % 9}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    run = lambda: sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, marks).collect())
    whole = run()
    from strandline.llm import rowsets

    monkeypatch.setattr(rowsets, "MOST_SETS", 0)
    assert run() == whole


def test_rare_language_does_not_cut_the_others(spark):
    rng = random.Random(3)
    makers = [language(rng, k) for k in range(3)]
    rows = [(k, makers[k % 2](3000), f"l{k % 2}") for k in range(60)] + [(999, makers[2](5), "l2")]
    dicts = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(dicts["l0"]) == len(dicts["l1"]) > 20000 > len(dicts["l2"]) > 0


def test_one_language_ties_and_one_row(spark):
    docs = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["b", "a", "a", "b"] * 5)], "doc_id long, text string, lang string")
    got = langid.predicted(docs).collect()
    assert len({(r.lang_pred, r.score) for r in got}) == 1 and all(r.rejected and r.margin == 0 for r in got)
    one = langid.predicted(docs.where("lang = 'a' and doc_id = 1")).collect()
    assert [(r.lang_pred, r.score) for r in one] == [("a", 1.0)]


def test_toxic_documents_are_found(spark):
    rng = random.Random(5)
    plain, bad = [f"w{k}o" for k in range(300)], ["vile", "rottenthing", "Scoundrel"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = rng.choices(plain, k=rng.randint(5, 60)), int(k % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ","]))
        rows.append((k, " ".join(words), "x"))
        labels.append((k, toxic, toxic))
    labels += [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 1, 1)]
    docs = spark.createDataFrame(rows + [(i, t, "x") for i, t in ODD if i != 1], "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    text = dict((r[0], r[1]) for r in rows)
    for r in held:
        if r.doc_id % 4 == 0 and r.predicted:
            assert {text[r.doc_id][s.start : s.end].lower() for s in r.spans} <= {b.lower() for b in bad}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(docs, marks.where("false")).count() == docs.count()
    assert toxicity.toxicity(docs.where("false"), marks).count() == 0
