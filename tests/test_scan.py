"""Recurrences in blocks against walks along whole streams."""

import random

import numpy as np
import pytest

from strandline.operators import refs, scan


def frames(seed, n=900):
    rng = random.Random(seed)
    out = []
    for clip in (1, 2, None):
        idx = 0
        for _ in range(n if clip else 40):
            idx += rng.choice((1, 1, 1, 5))
            out.append((clip, idx, rng.choices("IPB", (1 if seed % 2 else 0, 12, 5))[0], rng.choice((0.0, 0.01, 0.05, 0.1, 0.2, 0.25)), rng.random() < 0.02, rng.random() < 0.8))
    return out


def walked_ema(rows, alpha):
    out, state, clip = {}, None, "none"
    for c, i, _, v, again, use in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if c != clip:
            clip, state = c, None
        if again:
            state = None
        if use and v is not None:
            state = v if state is None else alpha * v + (1 - alpha) * state
        out[c, i] = state
    return out


def walked_budget(rows, limit):
    out, clip = {}, "none"
    for c, i, kind, v, _, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if c != clip:
            clip, total, begun = c, 0.0, False
        if kind == "B":
            out[c, i] = False, None
        elif kind == "I" or not begun:
            total, begun = 0.0, True
            out[c, i] = False, 0.0
        else:
            total += v or 0.0
            out[c, i] = total >= limit, total
            if total >= limit:
                total = 0.0
    return out


@pytest.mark.parametrize("block", [7, 64, scan.BLOCK])
@pytest.mark.parametrize("seed", [0, 1])
def test_ema_and_budget_equal_a_walk(spark, block, seed):
    rows = [(*r[:3], None if k % 53 == 0 else r[3], *r[4:]) for k, r in enumerate(frames(seed))]
    df = spark.createDataFrame(rows, "clip_id int, frame_idx int, ptype string, v double, again boolean, use boolean").repartition(5)
    got = {(r.clip_id, r.frame_idx): r.ema for r in refs.ema(df, "v", 0.3, "again", "use", block=block).collect()}
    want = walked_ema(rows, 0.3)
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    got = {(r.clip_id, r.frame_idx): (r.promoted, r.spent) for r in refs.budget_anchors(df, "v", 0.5, block=block).collect()}
    want = walked_budget(rows, 0.5)  # shares add up to the limit exactly, again and again
    assert got.keys() == want.keys() and sum(p for p, _ in want.values()) > 100
    assert all(got[k][0] == want[k][0] and (want[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-12) for k in want)


def test_blocks_of_one_clip_lie_in_several_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).select(F.lit(1).alias("clip_id"), F.col("id").alias("frame_idx"), F.lit("P").alias("ptype"), (F.col("id") % 7 / 10.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = refs.ema(df, "v", 0.3, block=100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2500


def test_scan_of_affine_maps():
    rng = np.random.default_rng(3)
    a, b = rng.random(1000) * (rng.random(1000) > 0.05), rng.random(1000)
    a[0] = 0
    state, want = 0.0, []
    for x, y in zip(a, b):
        state = x * state + y
        want.append(state)
    assert np.allclose(scan.affine_scan(a, b), want) and scan.stepped_scan(a, b).tolist() == want and scan.scanned(a, b).tolist() == want
    a[1:] = 0.9
    assert np.allclose(scan.scanned(a, b), scan.stepped_scan(a, b)) and len(scan.scanned(a[:0], b[:0])) == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "clip_id int, frame_idx int, ptype string, v double")
    assert refs.ema(df, "v", 0.3).count() == 0 and refs.budget_anchors(df, "v", 0.5).count() == 0
