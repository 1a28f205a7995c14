"""Statistics against plain Python, rules in Spark against numpy, the lasso's optimum, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality
from tests.llm.test_models import ODD, language

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MARKS = ".,;:'\"-?()"


def plain(text):
    """STATISTICS of a text by loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [w.translate(LOW) for w in words]
    data, n = text.encode(), max(len(words), 1)
    lines = [tuple(re.findall(r"[^\x20\x09-\x0D]+", x.translate(LOW))) for x in text.split("\n")]
    lines = [x for x in lines if x]
    symbol = lambda c: c.isascii() and c.isprintable() and not c.isalnum() and c not in MARKS + " "
    big, small = (lambda w: sum(c.isascii() and c.isupper() for c in w)), (lambda w: sum(c.isascii() and c.islower() for c in w))
    share = lambda xs, of=n: sum(xs) / max(of, 1)
    grams = [tuple(low[k : k + 3]) for k in range(len(low) - 2)]
    sizes = [len(w.encode()) for w in words]
    return {
        "n_bytes": math.log1p(len(data)), "n_words": math.log1p(len(words)), "n_lines": math.log1p(len(lines)), "word_length": sum(sizes) / n, "longest": math.log1p(max(sizes, default=0)),
        "line_words": math.log1p(len(words) / max(len(lines), 1)), "upper": share([big(text)], len(data)), "digit": share([c in "0123456789" for c in text], len(data)),
        "space": share([c in " \t\n\v\f\r" for c in text], len(data)), "mark": share([c in MARKS for c in text], len(data)), "symbol": share([symbol(c) for c in text], len(data)),
        "wide": share([len(c.encode()) for c in text if not c.isascii()], len(data)), "shouted": share([big(w) > 1 and not small(w) for w in words]), "titled": share([big(w) > 0 and small(w) > 0 for w in words]),
        "symbol_end": share([symbol(w[-1]) for w in words]), "stop_end": share([w[-1] in ".!?" for w in words]), "no_letter": share([not any(c.isalpha() or not c.isascii() for c in w) for w in words]),
        "short": share([s <= 2 for s in sizes]), "again": share([a == b for a, b in zip(low, low[1:])]), "top": max(Counter(low).values(), default=0) / n, "distinct": len(set(low)) / n,
        "grams_again": share([len(grams) - len(set(grams))], len(grams)), "lines_again": share([len(lines) - len(set(lines))], len(lines)),
    }


TEXTS = ["", "   \n\t", "One word", "THE QUICK!! BROWN FOX!! fox fox Fox.\n\nthe quick\nTHE QUICK\n", "a | b | c\nd | e", "é È naïve — 日本語。 $$$ ### 12.5% x2", "no newline at the end?\r\n", "\x00\x01 ctrl", "w " * 500, "a b c a b c a b c"]


def test_statistics_equal_plain_python():
    data = b"".join(t.encode() for t in TEXTS)
    offsets = np.cumsum([0] + [len(t.encode()) for t in TEXTS])
    got = quality.statistics(offsets, np.frombuffer(data, np.uint8))
    assert tuple(got) == quality.STATISTICS
    for k, t in enumerate(TEXTS):
        for c, v in plain(t).items():
            assert got[c][k] == pytest.approx(v, abs=1e-9), (t, c)


def junk(rng, text):
    kind = rng.randrange(3)
    if kind == 0:
        return text.upper().replace(" ", "!! ")
    if kind == 1:
        return " ".join(w + rng.choice(("$$$", "###", "%%%")) for w in text.split())
    return " ".join(w for w in text.split()[:8] for _ in range(12))


def corpus(n=900):
    rng = random.Random(7)
    makers = [language(rng, k) for k in range(2)]
    docs, labels = [], []
    for k in range(n):
        text = ". ".join(makers[k % 2](rng.randint(4, 12)).capitalize() for _ in range(rng.randint(1, 8))) + "."
        good = rng.random() > 0.3
        docs.append((k, text if good else junk(rng, text)))
        if k % 4:
            labels.append((k, int(good)))
    return docs, labels, {k for k, t in docs if "." not in t or "!!" in t or "$" in t or "#" in t or "%" in t}


def test_quality_on_held_out_rows(spark):
    docs, labels, _ = corpus()
    known = dict(labels)
    odd = [(i, t) for i, t in ODD]
    table = spark.createDataFrame([(*r, 1, None) for r in docs + odd], "doc_id long, text string, n_words int, good string").repartition(3)
    told = spark.createDataFrame([*labels, (None, 1), (3, None), (9005, 0)], "doc_id long, quality int")
    got = quality.quality(table, told).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 150 and sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)
    # labels of held-out rows, and other columns, are never looked at
    turned = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, q in labels] + [(9005, 0)]
    again = quality.quality(table, spark.createDataFrame(turned, "doc_id long, quality int")).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)


def test_rules_hold_alike_in_spark_and_numpy(spark):
    docs, labels, _ = corpus(300)
    stats = quality.staged(quality.measured(spark.createDataFrame(docs, "doc_id long, text string")), "statistics")
    model = quality.learned(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert model.rules and all(1 <= len(r.bounds) <= quality.DEPTH for r, _ in model.rules)
    rows = stats.select(*quality.STATISTICS, model.score().alias("s"), *[F.expr(r.sql()).alias(f"r{k}") for k, (r, _) in enumerate(model.rules)]).collect()
    x = np.array([r[: len(quality.STATISTICS)] for r in rows])
    held = np.column_stack([r.holds(x) for r, _ in model.rules])
    assert np.array_equal(held, np.array([r[len(quality.STATISTICS) + 1 :] for r in rows]))
    z = held @ np.array([w for _, w in model.rules]) + model.constant
    assert np.allclose([r["s"] for r in rows], 1 / (1 + np.exp(-z)))


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    held = rng.random((400, 30)) < rng.random(30)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * held[:, 0] - 3 * held[:, 1])))).astype(float)
    w, c = quality.lasso(held, y, 0.01, 3000)
    slope = held.T @ (1 / (1 + np.exp(-(held @ w + c))) - y) / 400
    assert abs((1 / (1 + np.exp(-(held @ w + c))) - y).mean()) < 1e-4
    assert np.abs(slope[w == 0]).max() <= 0.01 + 1e-4 and np.abs(slope[w != 0] + 0.01 * np.sign(w[w != 0])).max() < 1e-4
    assert 0 < (w != 0).sum() < 20 and w[0] > 0 > w[1]


def test_paths_are_nodes_of_one_tree():
    rng = np.random.default_rng(2)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.3)).astype(float)
    rules = quality.rules_of(x, y, trees=1)
    both = [r for r in rules if {b[0] for b in r.bounds} >= {quality.STATISTICS[3], quality.STATISTICS[5]}]
    assert both and max(y[r.holds(x)].mean() for r in both) > 0.95


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (5, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in (1, 2, 5)], "doc_id long, quality int")
    assert len({r.score for r in quality.quality(docs, one).collect()}) == 1 and quality.quality(docs.where("false"), one).count() == 0
