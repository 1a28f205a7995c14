"""Kernels, readers and writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import columns, kernels
from strandline.operators import tiles
from strandline.sources import readers, sinks


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.random((16, 20)) * 255
    assert kernels.psnr(x, x) == float("inf") and abs(kernels.ssim(x, x) - 1) < 1e-12 and kernels.ssim(x, 255 - x) < 0.5
    assert np.allclose(kernels.resized(x, 16, 20, "bicubic"), x) and np.allclose(kernels.resized(x, 8, 10, "area"), kernels.halved(x))
    assert np.allclose(kernels.backward_warp(x, np.full(x.shape, np.nan), np.full(x.shape, np.nan)), x)
    assert np.allclose(kernels.backward_warp(x, np.ones(x.shape), np.zeros(x.shape))[:, :-1], x[:, 1:])
    assert np.isnan(kernels.splat(x, np.ones(x.shape) * 3, np.zeros(x.shape), np.zeros(x.shape))[:, :3]).all()
    mask = np.zeros((8, 8), bool)
    mask[1:3, 1:3] = mask[5, 5] = mask[6, 6] = True
    assert kernels.dilated(mask, 3).sum() > mask.sum()
    assert np.allclose(kernels.grain(8, 8, 3, 2.0), kernels.grain(8, 8, 3, 2.0)) and not np.allclose(kernels.grain(8, 8, 3, 2.0), kernels.grain(8, 8, 4, 2.0))
    assert kernels.unsharp(x, 0, 1.0) is not None and np.allclose(kernels.unsharp(x, 0, 1.0), x)
    assert kernels.occlusion(np.full((4, 4), np.nan), np.zeros((4, 4)), np.zeros((4, 4)), np.zeros((4, 4))).all()
    assert np.allclose(kernels.half_level(x, np.full(x.shape, np.nan), x, x * 0), x)


def test_splat_and_warp_equal_kernels(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.random((8, 8)) * 255)
    df = spark.createDataFrame([(0, 5, p, float(v)) for p, v in enumerate(x.ravel())], "scene int, frame_idx long, pos int, luma double")
    v = spark.createDataFrame([(5, 1.25, -0.5)], "frame_idx long, dx double, dy double")
    dx, dy = np.full((8, 8), 1.25), np.full((8, 8), -0.5)
    got = np.full(64, np.nan)
    for r in tiles.splatted(df, v, F.col("luma") / 64).collect():
        got[r.pos] = r.luma
    assert np.allclose(got.reshape(8, 8), kernels.splat(x, dx, dy, x / 64), equal_nan=True)
    for r in tiles.warped(df, v).collect():
        got[r.pos] = r.luma
    assert np.allclose(got.reshape(8, 8), kernels.backward_warp(x, dx, dy))


def test_columns(spark):
    row = spark.range(1).select(
        columns.picture_type(F.lit(2)).alias("p"), columns.picture_type(F.lit(None).cast("int")).alias("q"), columns.seconds(F.lit(None).cast("int"), F.lit(1), F.lit(25)).alias("s"),
        columns.frame_count(F.lit(None).cast("long"), F.lit(2.0), F.lit(25.0)).alias("n"), columns.even_sample(F.lit(10), F.lit(20), 3).alias("e"), columns.luma(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("y"),
        columns.ramp(F.lit(5.0), 0.0, 10.0).alias("r"),
    ).first()
    assert (row.p, row.q, row.s, row.n, row.e, row.r) == ("P", "?", 0.0, 50, [10, 13, 16], 0.5) and abs(row.y - 1) < 1e-12


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "mv.csv").write_text("framenum,source,blockw,blockh,srcx,srcy,dstx,dsty,flags,motion_x,motion_y,motion_scale\n1,-1,16,16,0,0,8,8,0x1f,4,0,4\n1,1,8,8,0,0,4,4,0x0,0,4,4\n2,-1,8,8,1,1,2,2,0xA,0,0,4\n")
    got = sorted((r.frame_idx, r.mv_idx, r.flags) for r in readers.motion_csv(spark, str(tmp_path / "mv.csv"), "c").collect())
    assert got == [(0, 0, 31), (0, 1, 0), (1, 0, 10)]
    (tmp_path / "log.txt").write_text('noise\nRESULT_JSON {"name": "a", "wall_s": 1.5}\nRESULT_JSON broken\n')
    assert {(r.name, r.wall_s) for r in readers.result_log(spark, str(tmp_path / "log.txt"), "name string, wall_s double").collect()} == {("a", 1.5), (None, None)}
    files = spark.createDataFrame([("x.mp4", 1, 100, 25.0), ("x.mp4", 0, 50, 25.0), ("y.mp4", 1, 10, 0.0)], "name string, folder_rank int, n_frames long, fps double")
    modes = spark.createDataFrame([("fast", 130.0)], "mode string, ms_frame double")
    cat = readers.source_catalog(files, modes)
    assert {(r.name, r.seconds) for r in cat.collect()} == {("x.mp4", 6), ("y.mp4", 1)}
    assert readers.resolved(cat, "../../x.mp4").count() == 1
    with pytest.raises(FileNotFoundError):
        readers.resolved(cat, "../z")
    made = []
    make = lambda: made.append(1) or modes
    assert sinks.memoised(spark, str(tmp_path / "m"), make).count() == sinks.memoised(spark, str(tmp_path / "m"), make).count() == 1 and made == [1]
    kept = sinks.memoised(spark, str(tmp_path / "m"), make, n=1)
    assert made == [1] and kept.count() == 1
    sinks.memoised(spark, str(tmp_path / "m"), make, n=2)  # another number of rows than it should have
    sinks.memoised(spark, str(tmp_path / "m"), make, schema="other string")
    assert len(made) == 3
    sinks.metrics_csv(spark.createDataFrame([(1, None), (2, 0.5)], "frame int, psnr double").coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().split()
    assert text == ["frame,psnr", "1,", "2,0.5"]
    clip = readers.synthetic_clip(spark, 4)
    assert clip.count() == 4 and clip.repartition(3).orderBy("frame_idx").first()["plane"] == clip.orderBy("frame_idx").first()["plane"]
