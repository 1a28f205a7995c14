"""Rows picked by bit sets, spans merged, folders of staged tables."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from strandline.llm import rowsets, spans, staging


@pytest.mark.parametrize("most", [rowsets.MOST_SETS, 0])
def test_picked_rows(spark, most):
    rng = random.Random(1)
    every = sorted({rng.choice([rng.randrange(70_000), 32_767, 32_768, (1 << 40) + rng.randrange(50), 0]) for _ in range(3000)})
    some = set(rng.sample(every, 300)) | {5_000_000}
    rows = spark.createDataFrame([(u, f"t{u}") for u in every], "uid long, __set string")
    ids = spark.createDataFrame([(u,) for u in [*some, *list(some)[:50], None]], "k long")
    a, b = rowsets.split(rows, ids, "uid", most)
    assert a.columns == b.columns == rows.columns or most
    assert sorted(r.uid for r in a.collect()) == sorted(some & set(every))
    assert sorted(r.uid for r in b.collect()) == sorted(set(every) - some)
    assert rowsets.picked(rows, ids.where("false"), "uid", most).count() == 0


def test_merged_spans(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), lo, lo + rng.randint(1, 9), rng.randrange(5)) for lo in (rng.randrange(300) for _ in range(200))]
    got = spans.merged(spark.createDataFrame(rows, "uid int, lo int, hi int, other int"), ["uid"], "other").collect()
    want = set()
    for uid in range(4):
        held = []
        for _, lo, hi, _ in sorted(r for r in rows if r[0] == uid):
            if held and held[-1][1] >= lo:
                held[-1][1] = max(held[-1][1], hi)
            else:
                held.append([lo, hi])
        want |= {(uid, *h) for h in held}
    assert {(r.uid, r.lo, r.hi) for r in got} == want and len(got) == len(want)


def test_scratch_leaves_other_threads_alone(spark):
    df, told, seen = spark.range(3), threading.Event(), []

    def other():
        seen.append(staging.staged(df, "other"))
        told.set()

    with staging.scratch(spark) as kept:
        mine = staging.staged(df, "mine")
        t = threading.Thread(target=other)
        t.start()
        told.wait(30)
        t.join()
        kept.append(staging.staged(df, "kept"))
    assert seen[0].count() == 3 and kept[0].count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(mine.staged_path).count()


def test_rows_that_change_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).write.parquet(path)
    docs = spark.read.parquet(path)
    assert staging.steady(docs.where("id > 3")) is not docs and not hasattr(staging.steady(docs.where("id > 3")), "staged_path")
    assert hasattr(staging.steady(docs.withColumn("x", F.rand())), "staged_path")


def test_cuts_and_picks_beyond_the_bit_sets(spark, monkeypatch, tmp_path):
    """Tables of more rows than bit sets are made for meet their numbers in a shuffle, with the same results."""
    from strandline.llm import decontam, minhash, suffix_dedup

    sha = "array_join(transform(sequence(1, {n}), k -> sha(concat({seed}, '-', k))), ' ')"
    path = str(tmp_path / "docs")
    spark.range(40, numPartitions=2).select(F.col("id").alias("doc_id"), F.expr(sha.format(n="60 + id % 37", seed="id div 2")).alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    items = docs.where("doc_id in (6, 20)").select(F.col("doc_id").alias("item_id"), "text")
    runs = (minhash.first_of_each, suffix_dedup.without_repeats, lambda d: decontam.without_hits(d, items))
    want = [sorted(map(tuple, f(docs).collect())) for f in runs]
    monkeypatch.setattr(rowsets, "MOST_SETS", 0)
    assert [sorted(map(tuple, f(docs).collect())) for f in runs] == want
    assert 20 <= len(want[0]) < 40 and 36 <= len(want[2]) < 40
