"""Near duplicates against all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm import minhash
from strandline.llm.textops import SPACED_WORD


def shingles(text):
    w = re.findall(SPACED_WORD, (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    named = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    return sorted(((i, len(sets[k]), named[find(k)], i == named[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, ident = [], 0
    line = " ".join(rng.choices(words, k=30))
    for size in (1, 1, 2, 5, 40, 60):  # groups of edited copies, one large
        base = rng.choices(words, k=80)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(80)] = rng.choice(words)
            ident += 1
            rows.append((ident, " ".join(own)))
    rows += [(1000 + k, line + " " + " ".join(rng.choices(words, k=60))) for k in range(40)]  # a common line alone
    rows += [(2000 + k, "Same Text of exactly seven words here") for k in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "one two"), (3004, "ONE two"), (3005, "one two three"), (None, "one two"), (None, "alone in the null row group"), (1, rows[0][1])]
    rows.append((4000, " ".join(rng.choices(words, k=30000))))
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, uid int, n string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, sketch string")
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute(rows) if r[3]}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.first_of_each(docs).count() == 0


def test_a_hot_value_in_unlike_documents_makes_no_link(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("a very common first line "), F.expr("array_join(transform(sequence(0, 40), k -> sha(cast(id * 100 + k as string))), ' ')")).alias("text"))
    assert minhash.near_duplicates(docs).where("not kept").count() == 0


def test_counts_of_hot_and_other_keys(spark):
    from strandline.llm.skew import with_counts

    keys = [1] * 50 + [2, 2, 3, None, None] + [k for k in range(10, 30) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(keys)), "uid long, key long").repartition(4, "uid")
    want = sorted((k, u, keys.count(k)) for u, k in enumerate(keys) if k is not None and keys.count(k) > 1)
    for most in (1, 5, 10_000):  # no key is hot, one is, all are
        got = with_counts(rows, "key", "c", most_hot=most)
        assert sorted((r.key, r.uid, r.c) for r in got.collect()) == want


def test_unlike_rows_of_one_id_all_stay(spark):
    text = lambda k: " ".join(f"x{k}y{j}" for j in range(20))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (7, text(4)), (9, text(4)), (None, text(3)), (None, ""), (None, None), (8, ""), (8, "")]
    kept = minhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (None, ""), (None, ""), (8, "")], key=str)


@pytest.mark.parametrize(("few", "short", "docs", "percent"), [(0, 2, 3, 75), (0, 2, 800, 75), (0, 12, 800, 60)])
def test_lists_of_full_sets_and_blocks_equal_brute_force(spark, monkeypatch, few, short, docs, percent):
    """A notice that makes up from half to all of many documents, and near copies among these."""
    for name, value in (("FEW", few), ("SHORT", short), ("BLOCK_DOCS", docs)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(6)
    words, rows = [f"w{k}" for k in range(5000)], []
    notice = " ".join(rng.choices(words, k=60))
    for k in range(70):
        own = rng.choices(words, k=rng.choice([3, 8, 11, 14, 18, 25, 60]))
        rows.append((k, f"{notice} {' '.join(own)}"))
        if k % 3 == 0:
            own[rng.randrange(len(own))] = "other"
            rows.append((500 + k, f"{notice} {' '.join(own)}"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, share=0.42 if percent == 75 else 0.25).collect()), key=str)
    assert got == brute(rows, percent)
