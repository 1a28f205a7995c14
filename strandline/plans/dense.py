"""Queries that run kernels on the planes of tiles: guesses of left-out frames, degraded and restored planes, seams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import flow, kernels, regions, tables
from .recon import planes, small_motion, with_neighbours

SIDE = 8


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector a frame over half of its pixels: frame_idx, dx, dy."""
    m = views.mvs(spark, d).where("mv_idx = 0")
    return m.select(F.col("frame_id").alias("frame_idx"), (F.col("motion_x") / 16.0).alias("dx"), (F.col("motion_y") / 8.0).alias("dy"))


def interpolation_scores(own: DataFrame, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, method, psnr, ssim and hole_share for each frame of own that is left out and guessed from its neighbours.

    own: scene, frame_idx, plane, before, after (planes), dx, dy (of the frame), next_dx, next_dy (of the one
    after it; null: no vector).  Vectors hold on the left half of the plane.
    """

    def field(dx, dy, sign):
        out = np.full((2, side, side), np.nan)
        if dx is not None and not np.isnan(dx):
            out[0, :, : side // 2], out[1, :, : side // 2] = sign * dx, sign * dy
        return out[0], out[1]

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                truth, before, after = (np.asarray(v, float).reshape(side, side) for v in (r.plane, r.before, r.after))
                forward, backward = field(r.dx, r.dy, 1), field(r.next_dx, r.next_dy, -1)
                bad = kernels.occlusion(*forward, truth, before), kernels.occlusion(*backward, truth, after)
                for method, guess in kernels.between(before, after, forward, backward, distrust=bad).items():
                    guess = kernels.levels(guess)
                    out.append((r.scene, r.frame_idx, method, kernels.psnr(guess, truth), kernels.ssim(guess, truth), float(bad[0].mean())))
            yield pd.DataFrame(out, columns=["scene", "frame_idx", "method", "psnr", "ssim", "hole_share"])

    return own.mapInPandas(run, "scene int, frame_idx long, method string, psnr double, ssim double, hole_share double")


def held_out_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by scene and method of inner frames that are left out and guessed."""
    v = _vectors(spark, d)
    f = with_neighbours(planes(spark, d).select("scene", "frame_idx", "plane", "k"), ["before", "after"], "k")
    after = v.select(F.col("frame_idx").alias("after_idx"), F.col("dx").alias("next_dx"), F.col("dy").alias("next_dy"))
    f = f.join(v, "frame_idx", "left").join(after, "after_idx", "left")
    out = interpolation_scores(f)
    return out.groupBy("scene", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"), F.avg("hole_share").alias("hole_share"))


def restored(own: DataFrame, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, mode, config, psnr, ssim, gradient of each plane after each way of degrading and restoring."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                truth = np.asarray(r.plane, float).reshape(side, side)
                for mode in ("clean", "real"):
                    small = kernels.degraded(truth, mode, int(r.frame_idx))
                    for config, up in kernels.RESTORERS.items():
                        x = kernels.levels(np.rint(np.clip(up(small, side, side), 0, 255)))
                        out.append((r.scene, r.frame_idx, mode, config, kernels.psnr(x, truth), kernels.ssim(x, truth), kernels.gradient_fidelity(x, truth)))
            yield pd.DataFrame(out, columns=["scene", "frame_idx", "mode", "config", "psnr", "ssim", "gradient"])

    return own.mapInPandas(run, "scene int, frame_idx long, mode string, config string, psnr double, ssim double, gradient double")


def degrade_restore(spark: SparkSession, d: str) -> DataFrame:
    """The metrics matrix: means by mode and upscaler, and how often each one is best."""
    m = restored(planes(spark, d).select("scene", "frame_idx", "plane"))
    best = F.max("psnr").over(Window.partitionBy("scene", "frame_idx", "mode"))
    m = m.withColumn("best", F.col("psnr") >= best)
    return m.groupBy("mode", "config").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("psnr", "ssim", "gradient")], F.avg(F.col("best").cast("double")).alias("best_share"))


def seams(own: DataFrame, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, seam and halo of planes with mattes (plane, alpha), before and after feathering and ring restoration."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                x, a = (np.asarray(v, float).reshape(side, side) for v in (r.plane, r.alpha))
                for variant, picture, matte in (("plain", x, a), ("feathered", kernels.ring_restored(x, a), kernels.feathered(a))):
                    profile = kernels.halo_profile(picture, matte, most=side, size=3)
                    out.append((r.scene, r.frame_idx, variant, kernels.seam_ratio(picture, matte), kernels.halo_width(profile, side, far=side // 2), float(matte.sum())))
            yield pd.DataFrame(out, columns=["scene", "frame_idx", "variant", "seam", "halo", "area"])

    return own.mapInPandas(run, "scene int, frame_idx long, variant string, seam double, halo int, area double")


def seam_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Seams of every tile under a round matte."""
    x, y = "(k % 8 - 3.5)", "(floor(k / 8) - 3.5)"
    alpha = F.expr(f"transform(sequence(0, 63), k -> least(greatest((4.5 - sqrt({x} * {x} + {y} * {y})) / 2.5, 0.0), 1.0))")
    own = planes(spark, d).select("scene", "frame_idx", "plane", alpha.alias("alpha"))
    return seams(own).groupBy("scene", "variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.nanvl("seam", F.lit(None).cast("double"))).alias("seam"), F.avg("halo").alias("halo"), F.avg("area").alias("area"))


BUDGET = 1 << 19  # values of planes that a task works out side by side: the flow holds some hundred arrays of planes, so this is below 100 MB


def temporal_errors(own: DataFrame, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, config and tof of planes with the one before them: how far the motion between both after
    halving and restoring is from the true motion."""

    def run(batches):
        for rows in batches:
            step = max(1, BUDGET // (side * side * 8))
            for lo in range(0, len(rows), step):
                part = rows.iloc[lo : lo + step]
                now, before = (np.stack([np.asarray(p, float).reshape(side, side) for p in part[c]]) for c in ("plane", "before"))
                true = flow.dense_flow(before, now)
                for config, up in kernels.RESTORERS.items():
                    again = [np.stack([up(kernels.degraded(p, "clean"), side, side) for p in x]) for x in (before, now)]
                    dx, dy = flow.dense_flow(*again)
                    yield pd.DataFrame({"scene": part["scene"], "frame_idx": part["frame_idx"], "config": config, "tof": np.hypot(true[0] - dx, true[1] - dy).mean((1, 2))})

    return own.mapInPandas(run, "scene int, frame_idx long, config string, tof double")


def tile_tof(spark: SparkSession, d: str) -> DataFrame:
    """Mean temporal error by scene and upscaler, over all consecutive tiles of the scene."""
    own = with_neighbours(planes(spark, d).select("scene", "frame_idx", "plane", "k"), ["before"], "k")
    return temporal_errors(own).groupBy("scene", "config").agg(F.count(F.lit(1)).alias("n"), F.avg("tof").alias("tof"))


#: Levels and windows that fit tiles, whose levels lie around 128.
TILE_OVERLAY = {"both": 0.1, "white": 140, "dark": 116, "size": 3, "motion": 0.6, "grow": 3}


def field_of(mvs, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense dx, dy of a row's motion records, all sources."""
    names = ("w", "h", "dst_x", "dst_y", "motion_x", "motion_y", "motion_scale")
    return kernels.painted(np.array([[m[c] for c in names] for m in mvs]) if mvs is not None and len(mvs) else np.zeros((0, 7), int), side, side)


def overlays(own: DataFrame, side: int = SIDE, **options) -> DataFrame:
    """scene, frame_idx, kind (moving, static), area and box of the lettering in each plane (scene, frame_idx, plane, mvs); the box is null without any."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                x, mag = np.asarray(r.plane, float).reshape(side, side), np.hypot(*field_of(r.mvs, side))
                for kind in ("moving", "static"):
                    mask = regions.overlay(x, mag, kind == "moving", **options)
                    out.append((r.scene, r.frame_idx, kind, int(mask.sum()), *(regions.box_of(mask) or (None,) * 4)))
            got = pd.DataFrame(out, columns=["scene", "frame_idx", "kind", "area", "x0", "y0", "x1", "y1"])
            yield got.astype({c: "Int32" for c in ("x0", "y0", "x1", "y1")})

    return own.mapInPandas(run, "scene int, frame_idx long, kind string, area int, x0 int, y0 int, x1 int, y1 int")


def graphic_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and areas of lettering in every tile that moves, and that stands still."""
    own = planes(spark, d).join(small_motion(spark, d), "frame_idx", "left").select("scene", "frame_idx", "plane", "mvs")
    return overlays(own, **TILE_OVERLAY)


def denoised(own: DataFrame, sigma: float = 8.0, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, method and psnr of each plane with noise (seeded by its frame number) after each denoiser."""

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                x = np.asarray(r.plane, float).reshape(side, side)
                noisy = x + np.random.default_rng([7, int(r.frame_idx)]).normal(0, sigma, x.shape)
                for method, fn in [("none", lambda v: v), *regions.DENOISERS.items()]:
                    out.append((r.scene, r.frame_idx, method, kernels.psnr(fn(noisy), x)))
            yield pd.DataFrame(out, columns=["scene", "frame_idx", "method", "psnr"])

    return own.mapInPandas(run, "scene int, frame_idx long, method string, psnr double")


def denoised_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality by scene and denoiser over all tiles."""
    return denoised(planes(spark, d).select("scene", "frame_idx", "plane")).groupBy("scene", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("psnr").alias("psnr"))


def frozen_grain(own: DataFrame, sigma: float = 5.0, side: int = SIDE) -> DataFrame:
    """scene, chunk_id, frame_idx, mean, deviation and follows (correlation with the carried grain of the frame before) of the grain
    of each frame of a chunk (plane, mvs), which moves with the motion painted in it.  A chunk is a task's unit; its number seeds the grain."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx", kind="stable").reset_index(drop=True)
        fields = [field_of(m, side) for m in rows["mvs"]]
        grain = regions.frozen_grain(fields, sigma, int(rows["chunk_id"][0]) * 1009 + int(rows["scene"][0]))
        follows = [None, *(float(np.corrcoef(kernels.backward_warp(a, *f).ravel(), b.ravel())[0, 1]) for a, b, f in zip(grain, grain[1:], fields[1:], strict=False))]
        out = rows[["scene", "chunk_id", "frame_idx"]].copy()
        out["mean"], out["deviation"], out["follows"] = [float(g.mean()) for g in grain], [float(g.std()) for g in grain], follows
        return out

    return own.groupBy("scene", "chunk_id").applyInPandas(run, "scene int, chunk_id int, frame_idx long, mean double, deviation double, follows double")


def carried_grain(spark: SparkSession, d: str) -> DataFrame:
    """Grain that is carried along the motion of each chunk of tiles."""
    return frozen_grain(planes(spark, d).join(small_motion(spark, d), "frame_idx", "left").select("scene", "chunk_id", "frame_idx", "mvs"))


def produced(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of every scene by three producers: frames by source and their mean level."""
    tables.registered(spark)
    frames = planes(spark, d).join(small_motion(spark, d), "frame_idx", "left").select(F.col("scene").cast("long").alias("clip"), "frame_idx", "ptype", "plane", "mvs")
    name = f"frames_{uuid.uuid4().hex}"
    frames.createOrReplaceTempView(name)
    call = lambda p: f"SELECT '{p}' AS producer, * FROM produce(TABLE({name}) PARTITION BY clip ORDER BY frame_idx, producer => '{p}', side => 8, scale => 2)"
    out = spark.sql(" UNION ALL ".join(call(p) for p in sorted(tables.PRODUCERS)))
    spark.catalog.dropTempView(name)
    mean = F.aggregate("picture", F.lit(0.0), lambda s, v: s + v) / F.size("picture")
    return out.groupBy("producer", "clip", "source").agg(F.count(F.lit(1)).alias("n"), F.avg(mean).alias("level"))


QUERIES = {"held_out_scores": held_out_scores, "degrade_restore": degrade_restore, "seam_metrics": seam_metrics, "tile_tof": tile_tof, "graphic_tiles": graphic_tiles, "denoised_tiles": denoised_tiles, "carried_grain": carried_grain, "produced": produced}
ORACLE_SQL: dict[str, str] = {}
