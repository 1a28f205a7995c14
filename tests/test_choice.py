"""Medians in two passes against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import choice, motion, tiles


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_medians_equal_numpy(spark, width):
    rng = random.Random(1)
    rows = [(g, rng.choice((rng.uniform(-300, 300), float(rng.randint(-3, 3)))) if rng.random() < 0.9 else None) for g in (1, 2, 3, None) for _ in range(rng.choice((1, 2, 101, 400)))]
    rows += [(5, None), (6, 1.5), (7, -2.0), (7, 4.0)]
    got = {r.g: (r.m, r.n) for r in choice.medians(spark.createDataFrame(rows, "g int, v double").repartition(4), ["g"], F.col("v"), "m", width).collect()}
    want = {g: [v for h, v in rows if h == g and v is not None] for g in {r[0] for r in rows}}
    assert got == {g: (pytest.approx(np.median(v)), len(v)) for g, v in want.items() if v}


def test_groups_are_not_held_by_a_task(spark):
    """The plan has no aggregate that keeps all values of a group."""
    rows = spark.range(1000).select((F.col("id") % 2).alias("scene"), (F.col("id") % 3).cast("int").alias("pos"), F.col("id").alias("frame_idx"), (F.col("id") % 256).cast("double").alias("luma"))
    mvs = rows.select("frame_idx", F.col("frame_idx").alias("frame_id"), F.lit(0).alias("mv_idx"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(1).alias("motion_x"), F.lit(1).alias("motion_y"), F.lit(4).alias("motion_scale"))
    plate = tiles.plate_median(rows, F.col("luma") > 5, 3)
    verdict = motion.camera_verdict(mvs, (F.col("frame_id") % 2).cast("int"))
    plan = plate._jdf.queryExecution().executedPlan().toString()
    assert "median" not in plan and "percentile" not in plan
    got = {(r.scene, r.pos): r.value for r in plate.collect()}
    for (s, p), v in got.items():
        own = [i % 256 for i in range(1000) if i % 2 == s and i % 3 == p and i % 256 > 5]
        assert v == np.median(own)
    assert {r.verdict for r in verdict.collect()} == {"STATIC"}
