"""Ranked search against scores of all documents, under small shards, windows and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n_docs, n_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    tfs = [Counter(t) for t in terms]
    df = Counter(t for c in tfs for t in c)
    out = []
    for item_id, text in items:
        own, scored = set(TERM.findall((text or "").translate(LOW))), []
        for (doc_id, _), c, t in zip(docs, tfs, terms):
            score = 0
            for x in own & c.keys():
                m = 100 - 50 + 50 * len(t) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def tables(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["é̀x", "日本", "The"]
    weights = [1 / (i + 1) for i in range(len(words))]
    make = lambda n: "".join(w + rng.choice((" ", ", ", "\n", "--")) for w in rng.choices(words, weights, k=n))
    docs = [(k, make(rng.randint(0, 40))) for k in range(150)]
    docs += [(500 + k, docs[3][1]) for k in range(12)] + [(3, docs[3][1]), (None, docs[3][1]), (None, "the"), (600, None), (601, ""), (602, "!!"), (603, make(4000)), (604, "q" * 5000)]
    items = [(k, make(rng.randint(1, 12))) for k in range(12)] + [(1, "the w1 w2"), (None, "W3 w3 W4"), (20, None), (21, ""), (22, "nowhere"), (23, make(200))]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"shard_hits": 40, "window": 7}, {"shard_docs": 9, "window": 1, "most_terms": 20}, {"shard_docs": 1}])
@pytest.mark.parametrize("k", [3, 50])
def test_ranked_equals_brute_force(spark, k, sizes):
    docs, items = tables(k)
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, number int, score string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranking.ranked(d, i, k, **sizes).select("item_id", "rank", "doc_id", "score").collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(brute(docs, items, k), key=order)


def test_empty_tables(spark):
    docs, items = tables(1)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranking.ranked(d.where("false"), i).count() == 0 and ranking.ranked(d, i.where("false")).count() == 0
    assert ranking.ranked(d.where("doc_id in (600, 601, 602)"), i).count() == 0


def test_max_score_skips_but_loses_nothing():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 300))
        lists = []
        for _ in range(rng.integers(1, 8)):
            docs = np.flatnonzero(rng.random(n) < rng.random())
            if len(docs):
                lists.append((docs, rng.integers(0, 1 + 10 ** int(rng.integers(0, 4)), len(docs))))
        if not lists:
            continue
        total = np.zeros(n, np.int64)
        for docs, adds in lists:
            total[docs] += adds
        want = sorted((d for d in range(n) if total[d]), key=lambda d: (-total[d], d))[:5]
        docs, score = ranking.max_score(lists, n, 5, int(rng.integers(1, 64)))
        assert docs.tolist() == want and score.tolist() == total[want].tolist()
    # after the first window only documents of the rare list can enter, so the common one is only probed
    common, rare = (np.arange(10_000), np.full(10_000, 1)), (np.arange(0, 10_000, 100), np.full(100, 50))
    docs, score = ranking.max_score([common, rare], 10_000, 5, 512)
    assert docs.tolist() == [0, 100, 200, 300, 400] and set(score.tolist()) == {51}


def test_lengths_beyond_64_bits():
    got = ranking.part_of(np.array([3]), np.array([10**7]), 10**12, 10**15)
    assert got.tolist() == [3 * 10**9 // (3000 + 20 * (50 + 50 * 10**7 * 10**12 // 10**15))]
