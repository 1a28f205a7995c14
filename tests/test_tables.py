"""Table functions called from SQL against plain Python, and what they refuse."""

import math
import random

import numpy as np
import pytest

from strandline.functions import kernels, tables
from tests.test_regions import field

SIDE, SCALE = 8, 2


@pytest.fixture(scope="module")
def clips(spark):
    tables.registered(spark)
    rng, rows = random.Random(5), []
    for clip in (1, 2):
        for k in range(9):
            mvs = [(4, 4, rng.randrange(8), rng.randrange(8), rng.randint(-8, 8), rng.randint(-8, 8), 4) for _ in range(rng.randint(0, 3))]
            rows.append((clip, 10 * k, "I" if k in (4,) else rng.choice("PB"), [rng.uniform(0, 255) for _ in range(64)], mvs or None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "clip long, frame_idx long, ptype string, plane array<double>, mvs array<struct<w:int,h:int,dst_x:int,dst_y:int,motion_x:int,motion_y:int,motion_scale:int>>")
    df.repartition(3).createOrReplaceTempView("clips")
    return spark


def called(spark, producer):
    sql = f"SELECT * FROM produce(TABLE(clips) PARTITION BY clip ORDER BY frame_idx, producer => '{producer}', side => {SIDE}, scale => {SCALE})"
    return {(r.clip, r.frame_idx): (r.source, np.array(r.picture)) for r in spark.sql(sql).collect()}


def plain(spark, producer):
    out = {}
    rows = sorted(spark.table("clips").collect(), key=lambda r: (r.clip, r.frame_idx))
    before = clip = None
    for r in rows:
        up = kernels.resized(np.array(r.plane).reshape(SIDE, SIDE), SIDE * SCALE, SIDE * SCALE)
        if r.clip != clip:
            clip, before = r.clip, None
        if producer == "single" or before is None or r.ptype == "I":
            source, picture = "upscaled", up
        elif producer == "held":
            source, picture = "held", before
        else:
            dx, dy = field(r.mvs)
            source, picture = "warped", up.copy()
            for y in range(SIDE * SCALE):
                for x in range(SIDE * SCALE):
                    vx, vy = dx[y // SCALE, x // SCALE] * SCALE, dy[y // SCALE, x // SCALE] * SCALE
                    if not math.isnan(vx):
                        picture[y, x] = kernels.remap(before, np.array([[x + vx]]), np.array([[y + vy]]))[0, 0]
        before = picture
        out[r.clip, r.frame_idx] = source, picture.ravel()
    return out


@pytest.mark.parametrize("producer", sorted(tables.PRODUCERS))
def test_producers(clips, producer):
    got, want = called(clips, producer), plain(clips, producer)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k][1], want[k][1]) for k in want)


@pytest.mark.parametrize("motion", sorted(tables.PLATE_MOTIONS))
def test_plate_motions(clips, motion):
    clips.sql("SELECT clip, frame_idx, plane AS plate FROM clips").createOrReplaceTempView("plates")
    got = clips.sql(f"SELECT * FROM plate_view(TABLE(plates) PARTITION BY clip ORDER BY frame_idx, motion => '{motion}', speed => 0.75D, side => 8)").collect()
    plates = {(r.clip, r.frame_idx): np.array(r.plate).reshape(8, 8) for r in clips.table("plates").collect()}
    assert len(got) == len(plates) == 18
    for r in got:
        dx, dy = tables.PLATE_MOTIONS[motion](r.frame_idx // 10, 0.75)
        yy, xx = np.mgrid[:8, :8].astype(float)
        assert np.allclose(np.array(r.picture).reshape(8, 8), kernels.remap(plates[r.clip, r.frame_idx], xx + dx, yy + dy))


@pytest.mark.parametrize("policy", sorted(tables.POLICIES))
def test_policies(clips, policy):
    rng = random.Random(9)
    rows = [(c, p, i, rng.uniform(0, 255), rng.uniform(0, 255), rng.uniform(0, 255), rng.random() < 0.2, rng.random() < 0.7, rng.random()) for c in (1, 2) for p in range(4) for i in range(12)]
    names = "clip long, pos int, frame_idx long, cheap double, heavy double, value double, anchor boolean, run boolean, trust double"
    clips.createDataFrame(rows, names).repartition(4).createOrReplaceTempView("places")
    got = {(r.clip, r.pos, r.frame_idx): r.value for r in clips.sql(f"SELECT * FROM soften(TABLE(places) PARTITION BY (clip, pos) ORDER BY frame_idx, policy => '{policy}', gain => 0.6D, beta => 0.85D)").collect()}
    soft = {}
    for c, p, i, cheap, heavy, value, anchor, run, trust in rows:
        s = None if anchor else soft.get((c, p))
        if run:
            s = heavy - cheap if s is None else 0.15 * (heavy - cheap) + 0.85 * s
            if not anchor:
                a = min(max(0.6 * trust, 0), 1)
                value = min(max((1 - a) * value + a * {"cheap": cheap, "heavy": heavy, "smoothed": cheap + s}[policy], 0), 255)
        soft[c, p] = s
        assert got[c, p, i] == pytest.approx(value)
    assert len(got) == len(rows)


@pytest.mark.parametrize(("sql", "why"), [
    ("produce(TABLE(clips) PARTITION BY clip ORDER BY frame_idx, producer => 'no', side => 8, scale => 2)", "must be one of"),
    ("produce(TABLE(clips) PARTITION BY clip ORDER BY frame_idx, producer => 'held', side => 8, scale => 0)", "above 0"),
    ("plate_view(TABLE(clips) PARTITION BY clip ORDER BY frame_idx, motion => 'pan', speed => 1.0D, side => 8)", "lacks plate"),
])
def test_what_analysis_refuses(clips, sql, why):
    with pytest.raises(Exception, match=why):
        clips.sql(f"SELECT * FROM {sql}").collect()


class Flat(tables.Produce):
    """A producer of one's own: a handler that sets it."""

    def __init__(self):
        class Own:
            def frame(self, ptype, plane, dx, dy, scale):
                return "flat", np.full((SIDE * scale, SIDE * scale), plane.mean())

        self.own = Own()


def test_a_producer_of_ones_own(clips):
    from pyspark.sql.functions import udtf

    clips.udtf.register("produce_flat", udtf(Flat))
    rows = clips.sql("SELECT * FROM produce_flat(TABLE(clips) PARTITION BY clip ORDER BY frame_idx, producer => 'single', side => 8, scale => 2)").collect()
    assert len(rows) == 18 and {r.source for r in rows} == {"flat"} and all(len(set(r.picture)) == 1 for r in rows)
