"""Operators over frame streams against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import motion, refs, routing, schedule, segment, stats
from strandline.streaming import online


def clips(n=3, length=90, seed=0):
    rng = random.Random(seed)
    return [(c, k, rng.choice("IPPPBBB") if k else "I", rng.uniform(0, 300) if rng.random() < 0.2 else 100 + rng.uniform(-5, 5), rng.uniform(0, 200)) for c in range(n) for k in range(length)]


def frames(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, frame_idx int, ptype string, luma double, chroma double").repartition(4)


def cuts_of(rows, chroma):
    out, state = [], {}
    for c, k, t, y, u in sorted(rows):
        s = state.get(c)
        if s is None:
            state[c] = dict(y=y, u=u, base=None, cbase=None, last=k)
            continue
        d, dc = abs(y - s["y"]), abs(u - s["u"]) if chroma else 0.0
        hit = d > 60 or (t == "I" and d > 45) or (s["base"] is not None and d > 40 and d > 8 * s["base"])
        hit = hit or (dc > 1.1 * d and (dc > 60 or (s["cbase"] is not None and dc > 22 and dc > 6 * s["cbase"])))
        if hit and k - s["last"] >= 24:
            out.append((c, k))
            s.update(base=None, cbase=None, last=k)
        else:
            s["base"] = d if s["base"] is None else 0.3 * d + 0.7 * s["base"]
            s["cbase"] = dc if s["cbase"] is None else 0.3 * dc + 0.7 * s["cbase"]
        s.update(y=y, u=u)
    return out


@pytest.mark.parametrize("chroma", [None, "chroma"])
def test_cuts(spark, chroma):
    rows = clips()
    got = segment.scene_cuts(frames(spark, rows), chroma=chroma).where("is_cut").select("clip_id", "frame_idx").collect()
    assert sorted(map(tuple, got)) == cuts_of(rows, chroma)


def test_segments_are_contiguous_and_hold_their_frames(spark):
    cut = segment.scene_cuts(frames(spark, clips(5, 130, 2)))
    segs = segment.segments(cut)
    by_clip = {}
    for r in segs.orderBy("clip_id", "sid").collect():
        by_clip.setdefault(r.clip_id, []).append((r.s0, r.s1))
    for parts in by_clip.values():
        assert parts[0][0] == 0 and parts[-1][1] == 130 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    held = {(r.clip_id, r.frame_idx): r.sid for r in segment.scene_of(cut, segs).collect()}
    assert all(held[c, k] == next(i for i, (a, b) in enumerate(by_clip[c]) if a <= k < b) for c, k in held)


def test_chunks_begin_at_borders_only(spark):
    rows = sorted((r.clip_id, r.frame_idx, r.ptype, r.is_cut, r.chunk_id, r.place) for r in segment.gop_chunks(segment.scene_cuts(frames(spark, clips())), 6).collect())
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] == b[0]:
            new = b[2] == "I" or b[3] or (a[5] + 1 >= 6 and b[2] == "P")
            assert (b[4] - a[4], b[5]) == ((1, 0) if new else (0, a[5] + 1))


def test_empty_and_single_frames(spark):
    f = frames(spark, [])
    assert segment.segments(segment.scene_cuts(f)).count() == 0 and segment.gop_chunks(segment.scene_cuts(f)).count() == 0
    one = frames(spark, [(1, 0, "B", 5.0, None)])
    assert [tuple(r) for r in segment.segments(segment.scene_cuts(one, chroma="chroma")).collect()] == [(1, 0, 0, 1)]
    assert refs.reference_links(one).first()["w_prev"] is None


def test_links_and_budget(spark):
    rows = clips(2, 40, 4)
    got = {(r.clip_id, r.frame_idx): r for r in refs.reference_links(frames(spark, rows)).collect()}
    for (c, k), r in got.items():
        back = [x[1] for x in rows if x[0] == c and x[2] != "B"]
        assert r.prev_ref == max((x for x in back if x < k), default=None) and r.next_ref == min((x for x in back if x > k), default=None)
        if r.w_prev is not None:
            assert abs(r.w_prev + r.w_next - 1) < 1e-12
    promoted = refs.budget_anchors(frames(spark, rows).withColumn("hole", F.lit(0.3)), "hole", 0.5).where("ptype <> 'B'").orderBy("clip_id", "frame_idx").collect()
    run = 0
    for r in promoted:
        run = 0 if r.ptype == "I" else run + 1
        assert r.promoted == (run == 2)
        run = 0 if run == 2 else run


def test_last_record_stays_on_top(spark):
    recs = [(1, k, -1, 4, 4, x, y, k, -k, 4) for k, (x, y) in enumerate([(2, 2), (3, 3), (0, 0), (7, 7), (3, 2)])] + [(1, 9, 1, 4, 4, 1, 1, 5, 5, 0), (2, 0, -1, 0, 0, 1, 1, 1, 1, 4)]
    df = spark.createDataFrame(recs, "frame_id long, mv_idx int, source int, w int, h int, dst_x int, dst_y int, motion_x int, motion_y int, motion_scale int")
    grid = {}
    for _, _k, s, w, h, x, y, mx, my, sc in recs[:-1]:
        if s < 0:
            for yy in range(max(y - h // 2, 0), min(y - h // 2 + h, 8)):
                for xx in range(max(x - w // 2, 0), min(x - w // 2 + w, 8)):
                    grid[yy, xx] = (mx / (sc or 1), my / (sc or 1))
    got = {(r.y, r.x): (r.dx, r.dy) for r in motion.rasterised(motion.direction(df, "past"), 8, 8).collect()}
    assert got == grid
    packed = spark.createDataFrame([(1, list(range(20))), (2, []), (3, [1] * 13)], "frame_id long, packed array<int>")
    assert sorted((r.frame_id, r.mv_idx, r.dst_x) for r in motion.unpacked(packed).collect()) == [(1, 0, 5), (1, 1, 15), (3, 0, 1)]


def test_schedule(spark):
    assert schedule.stalls(0.1, 10.0, 0.01, 5, False, 60, 50)[0] == 0
    late, start, last = schedule.stalls(1.0, 10.0, 0.01, 5, False, 2, 50)
    assert late > 0 and start > 1.0 and last > 49 / 10
    got = schedule.minimal_buffer(schedule.parameter_grid(spark, (0.2,), (10.0,), (0.01,), (24,)), 20, 100).collect()
    for r in got:
        best = next(b for b in range(1, 21) if schedule.stalls(0.2, 10.0, 0.01, 24, r.dedicated, b, 100)[0] == 0)
        assert r.min_buffer == best


def test_rules(spark):
    s = spark.createDataFrame([(1, 60.0, 0.0, 1, False, "STATIC", 0.5, 1.0), (2, 1.0, 11.0, 1, False, "STATIC", 0.5, 1.0), (3, 1.0, 4.0, 1, True, "STATIC", 0.5, 1.0), (4, 1.0, 1.0, 1, False, "MOVING", 0.5, 1.0), (5, 1.0, 1.0, 1, False, "STATIC", None, 1.0), (6, 1.0, 1.0, 1, False, "UNKNOWN", 0.0, 1.0), (7, 1.0, 1.0, 1, False, "STATIC", 0.5, 20.0), (8, 1.0, 1.0, 1, False, "STATIC", 0.5, None)], "clip long, fb_mean double, mag_median double, n_scenes int, hidden_cut boolean, verdict string, coverage double, plate_resid double")
    assert [r.mode for r in routing.recommended_mode(s).orderBy("clip").collect()] == ["quality", "quality", "quality", "instant", "instant", "instant", "quality", "layered"]
    curve = spark.createDataFrame([(1, k, g) for k, g in enumerate([8.0, 6.0, 2.0, 1.0])] + [(2, 0, -1.0), (2, 1, 0.0), (3, 0, 4.0), (3, 5, 3.0)], "c int, dist int, gap double")
    assert {r.c: r.half_life for r in stats.half_life(curve, ["c"]).collect()} == {1: 1.5, 2: None, 3: 5.0}


def test_streamed_cuts_equal_batch(spark):
    f = frames(spark, clips(4, 80, 6)).drop("chroma")
    batch = segment.gop_chunks(segment.scene_cuts(f), 10).select("clip_id", "frame_idx", "is_cut", "chunk_id")
    live = online.in_batches(spark, f, F.floor(F.col("frame_idx") / 27), 4, lambda s: online.online_cuts(s, soft_cap=10), "live")
    live = live.select("clip_id", "frame_idx", "is_cut", "chunk_id")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
