"""The mix against its targets, and the splitting tree."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import mixing


def water(sizes, names, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by giving out the excess again and again."""
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def rows():
    rng = random.Random(2)
    out = []
    for k in range(1500):
        source = rng.choice(["a", "a", "a", "b", "Z", None, "é", "c"])
        out.append((k, " ".join(["w"] * rng.randint(0, 60)) if k % 50 else None, source, k % 7, "x"))
    return out + [(8000, "same row", "b", 0, "x")] * 3 + [(None, "no id", "c", 0, "x"), (9000, "w " * 20000, "a", 0, "x")]


def test_targets_takes_and_reruns(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int, target string").repartition(3)
    got = mixing.mix_digest(docs).collect()
    sizes, taken, target = {}, {}, {}
    by_id = {r[0]: r[2] for r in rows()}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = water(sizes, sorted((s for s in sizes if s is not None)) + [None])
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= (10001 if s == "a" else 61)
    assert len(got) == len(rows())
    again = mixing.mix_digest(docs).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_has_a_row_for_each_take(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int, target string")
    mixed = mixing.mixed(docs, shards=8)
    assert mixed.columns == [*docs.columns, "mix_pass", "mix_shard"]
    assert mixed.count() == sum(len(r.shards) for r in mixing.mix_digest(docs, shards=8).collect())


def test_shards_grow_with_the_words():
    at = [mixing.shards_for(w, 3) for w in (0, 1e7, 1e9, 1e11)]
    assert at[0] == mixing.LEAST_SHARDS and at == sorted(at) and at[2] * mixing.SHARD_WORDS >= 1e9 and at[3] * mixing.SHARD_WORDS >= 1e11
    assert mixing.shards_for(1e14, 100_000) * 100_000 <= mixing.MOST_QUOTAS


def test_large_shards_spread_over_tasks(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int, target string")
    out = mixing.mixed(docs, shards=1).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert {r.mix_shard for r in out.collect()} == {0}


def test_splitting_tree_is_exact_and_even():
    draws = {0: 100, 1: 37, 2: 1, 3: 0}
    q = mixing.quotas(draws, shards=8, seed=1)
    assert {s: int(v.sum()) for s, v in q.items()} == draws
    total = sum(q.values())
    assert total.max() - total.min() <= 1
    same = mixing.quotas(draws, shards=8, seed=1)
    assert all((q[s] == same[s]).all() for s in draws)
    means = np.mean([mixing.quotas(draws, shards=8, seed=k)[0] for k in range(300)], axis=0)
    assert abs(means - 100 / 8).max() < 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_digest(docs).count() == 0
