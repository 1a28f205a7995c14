"""Painting of motion records: gates and tiles by bits against cells, and how often the records are shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import bits
from strandline.operators import motion, selection
from strandline.plans import motion as motion_plans
from strandline.plans import selection as plans

W, H = 70, 20  # rows of two words
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(4)
    rows = [(f, k, rng.choice([-1, -1, 1]), *rng.choices([3, 8, 16], k=2), rng.randint(-4, 74), rng.randint(-4, 24), rng.randint(-9, 9), rng.randint(-9, 9), 4) for f in range(40) for k in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows, "frame_id long, mv_idx int, source int, w int, h int, dst_x int, dst_y int, motion_x int, motion_y int, motion_scale int").repartition(5).cache()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_gates_by_bits_equal_a_join_with_cells(spark, records):
    gates = motion.rasterised(motion.direction(records, "past"), W, H).select("frame_id", "y", "x", ((F.col("x") + F.col("y")) % 2).cast("double").alias("gate"))
    want = selection.gated_records(records, gates, W, H).select("frame_id", "mv_idx")
    own = motion.covered_centres(records, F.col("source") < 0, W, H, ["frame_id", "mv_idx"])
    got = selection.on_background(own, F.when(F.col("covered"), ((F.col("x") + F.col("y")) % 2).cast("double"))).select("frame_id", "mv_idx")
    assert rows_of(got) == rows_of(want) and 0 < got.count() < records.count() == own.count()


def test_a_record_without_frame_or_place_is_background(spark, records):
    odd = spark.createDataFrame([(None, 0, -1, 8, 8, 5, 5, 1, 1, 4), (0, 99, -1, 8, 8, None, 5, 1, 1, 4)], records.schema)
    got = motion.covered_centres(records.unionByName(odd), F.col("source") < 0, W, H, ["frame_id", "mv_idx"])
    assert got.count() == records.count() + 2 and got.where("(frame_id is null or mv_idx = 99) and covered").count() == 0


def test_frames_without_painting_records_are_background(spark, records):
    """A task whose rows, or whose last frame, hold no record that paints."""
    future = records.withColumn("source", F.lit(1))
    own = motion.covered_centres(future, F.col("source") < 0, W, H, ["frame_id", "mv_idx"])
    assert own.count() == records.count() and own.where("covered").count() == 0
    last = records.withColumn("source", F.when(F.col("frame_id") < 39, F.col("source")).otherwise(1)).coalesce(1)
    assert motion.covered_centres(last, F.col("source") < 0, W, H, ["frame_id"]).where("frame_id = 39 and covered").count() == 0
    none = np.zeros(0, np.int64)
    assert list(bits.laid(none, none, none, none, none, 1, W, H)) == []


def test_tiles_by_bits_equal_painted_fields(records):
    past = motion.direction(records, "past")
    cells = motion.rasterised(past, W, H).withColumn("m", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    for s in (8, 12):
        want = cells.groupBy("frame_id", F.floor(F.col("y") / s).alias("ty"), F.floor(F.col("x") / s).alias("tx")).agg(F.count("*").alias("cells"), F.max("m").alias("most"))
        got = motion.tile_sums(past, [8, 12], W, H).where(F.col("size") == s).drop("size")
        assert rows_of(got) == rows_of(want)
        shares = want.groupBy("frame_id").agg(F.count("*"), F.avg((F.col("most") > 4).cast("double")))
        assert rows_of(motion.tile_shares(past, [s], 4.0, W, H).drop("size")) == rows_of(shares)
        full = {}
        for r in want.collect():
            full.setdefault(r.frame_id, []).append(r.cells)
        need = {f: next(k for k in range(1, len(n) + 1) if 10 * sum(sorted(n)[-k:]) >= 9 * sum(n)) for f, n in full.items()}
        assert {r.frame_id: (r.touched, r.needed) for r in motion.fullest_tiles(past, s, 9, W, H).collect()} == {f: (len(n), need[f]) for f, n in full.items()}


def test_spans_cross_words():
    got = bits.spans(np.array([0, 60, 64, 5]), np.array([64, 70, 128, 5]), 2)
    assert [[int(v) for v in r] for r in got] == [[2**64 - 1, 0], [0xF << 60, 0x3F], [0, 2**64 - 1], [0, 0]]


def test_records_are_dealt_once_and_no_cell_is_shuffled(spark):
    assert exchanges(plans.gated_motion(spark, SF)) <= 3  # records, the unframed ones (pruned), sums of frames
    assert exchanges(plans.texture_coverage(spark, SF)) == exchanges(motion_plans.tile_clusters(spark, SF)) == exchanges(motion_plans.flow_raster(spark, SF)) == 1
