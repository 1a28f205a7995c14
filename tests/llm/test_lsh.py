"""Recall and exactness of the nearest neighbours."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import lsh


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = np.lexsort((ids, d))
    return [(int(ids[o]), float(d[o])) for o in order if ids[o] != q][:k]


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, bucket int")


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1600] = x[5] + 0.01 * rng.standard_normal((600, 24))  # one crowd
    x[1700:1720] = x[0]  # equal vectors
    ids = np.arange(3000)
    got = {}
    for r in lsh.search(frame(spark, ids, x), F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 3000, 100):
        want = brute(ids, x.astype(float), q)
        own = [got[q][k] for k in range(1, 11)]
        hits += len({i for i, _ in own} & {i for i, _ in want})
        assert own == sorted(own, key=lambda p: (p[1], p[0]))
        for i, s in own:
            assert abs(s - float(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()))) < 1e-12
    assert hits >= 0.9 * 300
    assert [i for i, _ in (got[0][k] for k in range(1, 11))] == list(range(1700, 1710))


def test_split_buckets_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    x[:500] = x[0]  # one vector holds more than half of all rows, and most queries
    ids, every = np.arange(900), F.col("id") % 3 == 0
    run = lambda: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in lsh.search(frame(spark, ids, x), every).collect())
    whole = run()
    for name, value in (("LARGE", 20), ("STEP", 7)):
        monkeypatch.setattr(lsh, name, value)
    assert run() == whole and len(whole) == 3000
    assert [r[2] for r in whole if r[0] == 3] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_odd_rows_and_small_tables(spark):
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [1.0], 1), (None, [1.0, 2.0], 1), (7, [float("inf"), 0.0], 1), (1, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {(r.query_id, r["rank"]): r.vec_id for r in lsh.search(df, F.col("id") % 100 == 0).collect()}
    assert got == {(0, 1): 1, (0, 2): 100, (100, 1): 1, (100, 2): 0}
    assert lsh.search(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_probes_come_in_order_of_their_chance():
    index = lsh.Index(np.random.default_rng(0).standard_normal((200, 8)), 4000, 1.0)
    place = index.places(np.ones((1, 8)))[0, 0]
    cells = index.probes(place)
    assert (cells[0] == np.floor(place)).sum() >= index.k - 2 and len({tuple(c) for c in cells.tolist()}) == len(cells)
