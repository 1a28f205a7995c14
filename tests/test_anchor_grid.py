"""Anchors and drift of several operating points from one sort, against plain counting."""

import random

from strandline.operators import refs
from strandline.plans import measures


def plain(kinds, every):
    out, place, hops = [], -1, None
    for kind in kinds:
        on = kind != "B"
        place += on
        mark = kind == "I" or (on and place % every == 0)
        hops = 0 if mark else hops + 1 if on else hops
        out.append((mark, hops if on else None))
    return out


def test_grid_equals_plain_counting_and_the_single_operators(spark):
    rng = random.Random(2)
    clips = {c: [rng.choice("IPPPBBB") for _ in range(60)] for c in range(5)}
    df = spark.createDataFrame([(c, i, k) for c, kinds in clips.items() for i, k in enumerate(kinds)], "clip_id long, frame_idx int, ptype string").repartition(3)
    got = {(r.clip_id, r.frame_idx): r for r in refs.anchor_grid(df, [2, 8]).collect()}
    for k in (2, 8):
        want = {(c, i): v for c, kinds in clips.items() for i, v in enumerate(plain(kinds, k))}
        assert {key: (r[f"is_anchor_{k}"], r[f"hops_{k}"]) for key, r in got.items()} == want
        single = refs.drift_distance(refs.forced_anchors(df, ["clip_id"], every=k)).collect()
        assert {(r.clip_id, r.frame_idx): (r.is_anchor, r.hops) for r in single} == want


def test_drift_counts_from_a_b_frame_marked_as_anchor_and_before_any_anchor(spark):
    rows = [(1, i, k, a) for i, (k, a) in enumerate([("P", False), ("P", False), ("B", True), ("P", False), ("P", False), ("P", True), ("P", False)])]
    got = refs.drift_distance(spark.createDataFrame(rows, "clip_id long, frame_idx int, ptype string, is_anchor boolean")).orderBy("frame_idx").collect()
    assert [r.hops for r in got] == [0, 1, None, 0, 1, 0, 1]


def test_the_sweep_sorts_frames_once_for_all_points(spark):
    plan = measures.anchor_sweep(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("- Sort [") <= 3  # frames numbered, frames in order, points of a clip
