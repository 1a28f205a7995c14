"""Chunk reconstruction: anchors are upscaled, the frames between are warped from their references.

A chunk is a task's unit, bounded by the soft cap; inside it the backbone is a chain, since each
frame needs the result of the one before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import arrow, kernels

ROWS = "scene int, chunk_id int, frame_idx long, ptype string, is_anchor boolean, hole_frac double, hops int, psnr double"
PICTURES = ROWS + ", picture array<int>"


def reconstructed(side: int, scale: int, occlusion: str = "reactive", pictures: bool = False):
    """A grouped function over the frames of a chunk (plane, mvs) that gives a metric row per frame, with its picture if asked for.

    The upscaler is bicubic; a frame without any reference is upscaled on its own.  A column `mode` of
    `quality` makes every frame an anchor.
    """

    def warp(ref: np.ndarray, ref_lr: np.ndarray, cur_lr: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = kernels.painted(records, side, side)
        big = lambda v: kernels.resized(np.nan_to_num(v), side * scale, side * scale, "nearest") * scale
        moved = kernels.backward_warp(ref, big(dx), big(dy))
        rest = cur_lr - kernels.backward_warp(ref_lr, dx, dy)
        mask = kernels.occlusion(dx, dy, cur_lr, ref_lr, mode=occlusion)
        return moved + kernels.resized(rest, side * scale, side * scale, "bilinear"), mask

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_idx", kind="stable").reset_index(drop=True)
        planes = [np.asarray(p, float).reshape(side, side) for p in rows["plane"]]
        up = [kernels.resized(p, side * scale, side * scale) for p in planes]
        none = np.zeros((0, 7), int)
        mvs = [none if m is None or not len(m) else np.array([[r[c] for c in ("w", "h", "dst_x", "dst_y", "motion_x", "motion_y", "motion_scale")] for r in m]) for m in rows["mvs"]]
        past = [m[[r["source"] < 0 for r in raw]] if len(m) else m for m, raw in zip(mvs, rows["mvs"], strict=True)]
        future = [m[[r["source"] > 0 for r in raw]] if len(m) else m for m, raw in zip(mvs, rows["mvs"], strict=True)]
        kinds, n = rows["ptype"].tolist(), len(rows)
        backbone = [i for i in range(n) if kinds[i] in ("I", "P")]
        done: dict[int, np.ndarray] = {}
        hole, hops, anchor = np.zeros(n), [None] * n, [False] * n
        big = lambda m: kernels.resized(m.astype(float), side * scale, side * scale, "nearest") > 0.5
        alone = "mode" in rows and rows["mode"].iloc[0] == "quality"
        for at, i in enumerate(range(n) if alone else backbone):
            if alone or kinds[i] == "I" or at == 0:
                done[i], anchor[i], hops[i] = up[i], True, 0
                continue
            j = backbone[at - 1]
            moved, mask = warp(done[j], planes[j], planes[i], past[i])
            done[i], hole[i], hops[i] = np.where(big(mask), up[i], moved), mask.mean(), hops[j] + 1
        for i in range(n):
            if i in done:
                continue
            before = max((j for j in backbone if j < i), default=None)
            after = min((j for j in backbone if j > i), default=None)
            sides = [warp(done[j], planes[j], planes[i], m) + (abs(k - i),) for j, m, k in ((before, past[i], after), (after, future[i], before)) if j is not None for k in (k if k is not None else j,)]
            total, weight = np.zeros((side * scale,) * 2), np.zeros((side * scale,) * 2)
            holes = np.ones((side, side), bool)
            for moved, mask, w in sides:
                ok = ~big(mask) * float(w or 1)
                total, weight, holes = total + ok * moved, weight + ok, holes & mask
            done[i], hole[i] = np.where(weight > 0, total / np.where(weight > 0, weight, 1), up[i]), holes.mean()
        quality = [kernels.psnr(kernels.levels(kernels.resized(done[i], side, side, "area")), kernels.levels(planes[i])) for i in range(n)]
        out = rows[["scene", "chunk_id", "frame_idx", "ptype"]].copy()
        out["is_anchor"], out["hole_frac"], out["hops"], out["psnr"] = anchor, hole, pd.array(hops, "Int32"), quality
        if pictures:
            out["picture"] = [kernels.levels(done[i]).ravel().astype(int) for i in range(n)]
        return out

    return run


def planes(spark: SparkSession, d: str) -> DataFrame:
    """Tiles as planes, numbered in their scene by k: every 12th frame is I, every third P, the rest B; 12 frames a chunk."""
    e = views.table(spark, d, "embeddings").where("embedding is not null and label is not null")
    # numbers come from narrow rows; planes meet them by frame, not by scene
    k = e.select("vec_id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("k"))
    plane = F.transform("embedding", lambda v: F.least(F.greatest(v.cast("double") * 255 + 128, F.lit(0.0)), F.lit(255.0)))
    own = e.select("vec_id", "label", plane.alias("plane")).join(k, ["vec_id", "label"]).select(F.col("label").alias("scene"), F.col("vec_id").alias("frame_idx"), "plane", "k")
    kind = F.when(F.col("k") % 12 == 0, "I").when(F.col("k") % 3 == 0, "P").otherwise("B")
    return own.select("scene", F.floor(F.col("k") / 12).cast("int").alias("chunk_id"), "frame_idx", kind.alias("ptype"), "plane", "k")


def with_neighbours(own: DataFrame, sides: list[str], place: str | None = None) -> DataFrame:
    """own (scene, frame_idx, plane) with the planes of the frames `before` and `after` in the scene; frames that lack one are left out.

    place: a column that numbers the frames of a scene one by one.  Without it the numbers come from narrow rows, so no task holds the planes of a scene."""
    if place is None:
        number = own.select("scene", "frame_idx").withColumn("__k", F.row_number().over(Window.partitionBy("scene").orderBy("frame_idx")))
        return with_neighbours(own.join(number, ["scene", "frame_idx"]), sides, "__k").drop("__k")
    out = own
    for s in sides:
        step = F.col(place) + (1 if s == "before" else -1)
        out = out.join(own.select("scene", step.alias(place), F.col("frame_idx").alias(f"{s}_idx"), F.col("plane").alias(s)), ["scene", place])
    return out


def small_motion(spark: SparkSession, d: str) -> DataFrame:
    """frame_idx, mvs: the motion records of each frame, in order, made to fit 8x8 planes."""
    m = views.mvs(spark, d)
    small = m.select(
        F.col("frame_id").alias("frame_idx"), F.struct("mv_idx", "source", F.lit(4).alias("w"), F.lit(4).alias("h"), (F.col("dst_x") % 8).alias("dst_x"), (F.col("dst_y") % 8).alias("dst_y"), "motion_x", "motion_y", F.lit(8).alias("motion_scale")).alias("r")
    )
    return small.groupBy("frame_idx").agg(F.sort_array(F.collect_list("r")).alias("mvs"))


def chunk_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    frames = planes(spark, d).join(small_motion(spark, d), "frame_idx", "left")
    return frames.groupBy("scene", "chunk_id").applyInPandas(reconstructed(8, 2), ROWS)


def tile_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signal battery of every tile."""
    return planes(spark, d).withColumn("s", arrow.signals(8)("plane")).select("scene", "frame_idx", "s.*")


def tile_similarity(spark: SparkSession, d: str) -> DataFrame:
    """SSIM, gradient fidelity and PSNR of every tile against the one before in its scene."""
    own = with_neighbours(planes(spark, d), ["before"], "k")
    metric = lambda fn: arrow.pair_metric(fn, 8)("plane", "before")
    return own.select("scene", "frame_idx", metric(kernels.ssim).alias("ssim"), metric(kernels.gradient_fidelity).alias("gradient"), metric(kernels.psnr).alias("psnr"))


QUERIES = {"chunk_reconstruct": chunk_reconstruct, "tile_signals": tile_signals, "tile_similarity": tile_similarity}
ORACLE_SQL: dict[str, str] = {}
