"""Frames out of order over batches: the chunks of the batch operator, gaps, late frames, and clips that end."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from strandline.operators import segment
from strandline.streaming import online, reorder

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = f"{reorder.IN}, batch int"


def clip(clip_id, n, seed, gaps=()):
    rng, level, out = random.Random(seed), 100.0, []
    for i in range(n):
        level = rng.uniform(20, 235) if rng.random() < 0.05 else level + rng.uniform(-3, 3)
        if i not in gaps:
            out.append((clip_id, i, "I" if i == 0 or rng.random() < 0.03 else rng.choice("PPB"), level, START + timedelta(milliseconds=40 * i)))
    return out


def shuffled(rows, batches, reach, seed):
    """Frames dealt to batches by their time, moved by up to `reach` frames."""
    rng = random.Random(seed)
    n = max(r[1] for r in rows) + 1
    return [(*r, min(max((r[1] + rng.randint(-reach, reach)) * batches // n, 0), batches - 1)) for r in rows]


def run(spark, rows, batches, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = online.in_batches(spark, df, F.col("batch"), batches, lambda s: reorder.ordered_chunks(s, soft_cap=10, **options), "reorder")
    return out.collect()


def want(spark, rows):
    df = spark.createDataFrame([r[:4] for r in rows], "clip_id long, frame_idx int, ptype string, luma double")
    return {(r.clip_id, r.frame_idx): (r.diff, r.is_cut, r.chunk_id) for r in segment.gop_chunks(segment.scene_cuts(df), 10).collect()}


# frames of another clip, far ahead in time, move the watermark on so that the others end
def closing(batch, after):
    return [(99, 0, "I", 50.0, START + timedelta(seconds=after), batch)]


def test_frames_out_of_order_equal_the_batch_operator(spark):
    rows = clip(1, 90, 1) + clip(2, 40, 2)
    dealt = shuffled(rows, 4, 12, 3)
    assert any(a[1] > b[1] and a[5] < b[5] for a in dealt for b in dealt if a[0] == b[0])
    got = run(spark, dealt + closing(4, 500) + closing(5, 1000)[:0], 5, wait_ms=5000, idle_ms=60000)
    assert {(r.clip_id, r.frame_idx): (r.diff, r.is_cut, r.chunk_id) for r in got if r.clip_id != 99} == want(spark, rows)
    assert len(got) == len({(r.clip_id, r.frame_idx) for r in got}) and not any(r.late for r in got)


def test_a_gap_is_given_up_and_its_frame_is_late(spark):
    rows = clip(1, 60, 4, gaps=(20,))
    moved = lambda r, s: (*r[:4], r[4] + timedelta(seconds=s))
    missing = (1, 20, "P", 100.0, START + timedelta(seconds=9))  # behind its place, but not behind the watermark
    dealt = [(*r, 0) for r in rows if r[1] < 40] + closing(1, 6) + [(*moved(r, 6), 2) for r in rows if r[1] >= 40] + [(*missing, 3)]
    got = run(spark, dealt, 4, wait_ms=3000, idle_ms=600000)
    own = {(r.clip_id, r.frame_idx): (r.diff, r.is_cut, r.chunk_id) for r in got if r.clip_id == 1 and not r.late}
    assert own == want(spark, rows) and [(r.frame_idx, r.chunk_id) for r in got if r.late] == [(20, None)]


def test_a_clip_that_ends_is_flushed_and_its_state_is_gone(spark):
    first, gap = clip(1, 30, 5), clip(1, 30, 5)[12:]
    later = [(c, i, k, v, t + timedelta(seconds=900)) for c, i, k, v, t in clip(1, 25, 6)]
    # clip 1 lacks frames 10 and 11, ends, and the same key begins anew from frame 0
    dealt = [(*r, 0) for r in first[:10] + gap] + closing(1, 700) + [(*r, 2) for r in later] + closing(3, 2000)
    got = [r for r in run(spark, dealt, 4, wait_ms=5000, idle_ms=60000) if r.clip_id == 1]
    assert not any(r.late for r in got) and len(got) == 28 + 25
    rows = sorted((r.frame_idx, str(r.diff), r.is_cut, r.chunk_id) for r in got)
    old, new = want(spark, first[:10] + gap), want(spark, later)
    assert rows == sorted((i, str(d), c, k) for own in (old, new) for (_, i), (d, c, k) in own.items())


def test_calls_serve_packs_of_clips(spark):
    """State and calls are by pack: many clips, some in one pack, some far apart."""
    assert {n.split()[0] for n in reorder.STATE.split(", ")} >= {"clip", "w_clip"} and online.STATE.startswith("clip array")
    rows = clip(1, 30, 7) + clip(2, 25, 8) + clip(-3, 20, 9) + clip(5000, 30, 10)
    got = run(spark, shuffled(rows, 3, 6, 1), 3, wait_ms=5000, idle_ms=60000)
    assert {(r.clip_id, r.frame_idx): (r.diff, r.is_cut, r.chunk_id) for r in got} == want(spark, rows)
