"""Rules that route frames and clips by their signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold


def fallback_limit(ptype: Column, mag: Column, hole: Column, intra: Column, base: float = 0.50, high: float = 0.20, gate: float = 1.0, keyed: bool = False, saturation: float = 0.70, intra_gate: float = 0.80) -> Column:
    """The share of holes from which a frame is worked on: out of reach on saturated noise, lower on motion if keyed."""
    saturated = (hole > saturation) & (intra > intra_gate) if saturation < 1.0 else F.lit(False)
    moving = (ptype != "I") & (mag > gate) if keyed else F.lit(False)
    return F.when(saturated, F.lit(2.0)).when(moving, F.lit(high)).otherwise(F.lit(base))


def frame_source(is_anchor: Column, on_backbone: Column, hole: Column, limit: Column) -> Column:
    """anchor, upgrade (a backbone frame above its limit), patch (another frame above it) or cheap."""
    return F.when(is_anchor, "anchor").when(on_backbone & (hole > limit), "upgrade").when(hole > limit, "patch").otherwise("cheap")


def escalated(frames: DataFrame, limit: float, mag_gate: float | None = None) -> DataFrame:
    """Frames that are no anchors and whose holes exceed the limit, on motion above the gate if there is one."""
    ok = ~F.col("is_anchor") & (F.col("hole") > limit)
    return frames.where(ok & (F.col("mag") > mag_gate) if mag_gate is not None else ok)


#: Fixed values of the mode rules.
NOISE, CROWDED, FAST, SMEAR, HUMAN_LO, HUMAN_HI, RESIDUAL = 50.0, 15.0, 10.0, 3.0, 0.03, 0.85, 12.0


def recommended_mode(signals: DataFrame) -> DataFrame:
    """mode, reason and matte_unavailable of each clip: the first rule that holds.

    signals: fb_mean and mag_median, n_scenes, hidden_cut (boolean), verdict, coverage (null: no
    matte), plate_resid (null: unknown).  A coverage of 0 is a clip without people.
    """
    c = F.col
    missed = c("hidden_cut") & (c("n_scenes") == 1)
    still = c("verdict").isin("STATIC", "UNKNOWN") & ~c("hidden_cut")
    human = c("coverage").between(HUMAN_LO, HUMAN_HI)
    rules = [
        (c("fb_mean") > NOISE, "quality", "noise"),
        ((c("mag_median") > FAST) | (c("fb_mean") > CROWDED), "quality", "high motion or occlusion"),
        (missed & (c("mag_median") > SMEAR), "quality", "missed cut"),
        (~still, "instant", "layered unsafe"),
        (c("coverage").isNull(), "instant", "matte unavailable"),
        (~human, "instant", "no person in view"),
        (c("plate_resid") > RESIDUAL, "quality", "background not static"),
    ]
    mode, reason = F.lit("layered"), F.lit("static person")
    for test, m, why in reversed(rules):
        mode, reason = F.when(test, m).otherwise(mode), F.when(test, why).otherwise(reason)
    return signals.withColumn("mode", mode).withColumn("reason", reason).withColumn("matte_unavailable", F.col("reason") == "matte unavailable")


def best_by_outcome(clip_modes: DataFrame) -> DataFrame:
    """Per clip the mode that its measurements confirm: layered if safe and at least as steady as quality, instant if good
    and in real time, else quality.  clip_modes: clip, mode, tof, consistency, ms, safe."""
    wide = clip_modes.groupBy("clip").pivot("mode", ["instant", "quality", "layered"]).agg(
        F.first("tof").alias("tof"), F.first("consistency").alias("lr"), F.first("ms").alias("ms"), F.first("safe").alias("safe")
    )
    tof = lambda m: F.coalesce(F.col(f"{m}_tof"), F.lit(9.0))
    fast = F.coalesce(F.col("instant_ms"), F.lit(1e9)) <= 42.0
    layered = F.coalesce(F.col("layered_safe"), F.lit(False)) & (tof("layered") <= tof("quality"))
    best = F.when(layered, "layered").when(fast & (tof("instant") <= 1.5 * tof("quality")), "instant").when(F.col("quality_ms").isNotNull(), "quality").otherwise("instant")
    return wide.withColumn("best", best)


def deblock_gate(mode: str, qp: Column, blockiness: Column, texture: Column | None = None, qp_limit: int = 30, limit: float = 1.30, texture_limit: float = 0.5) -> Column:
    """Whether a frame is deblocked: always, by its quantiser, or by its blockiness (also where the quantiser is null)."""
    blocky = blockiness >= limit
    ok = F.lit(True) if mode == "always" else F.when(qp.isNull(), blocky).otherwise(qp >= qp_limit) if mode == "qp" else blocky
    return ok & (texture < texture_limit) if texture is not None else ok


def plate_is_bad(psnr: Column, baseline: Column, floor: float = 24.0, drop: float = 8.0) -> Column:
    """A background PSNR under the floor or far under its baseline; a PSNR that is not finite is trusted."""
    return F.when(psnr.isNull() | F.isnan(psnr) | (F.abs(psnr) == float("inf")), False).otherwise((psnr < floor) | F.coalesce(psnr < baseline - drop, F.lit(False)))


def guarded(frames: DataFrame, key: list[str], order: str, psnr: str, floor: float = 24.0, drop: float = 8.0, alpha: float = 0.30) -> DataFrame:
    """frames with bad and baseline: plate_is_bad against the moving average of the frames before in the stream that passed; the first one has none.

    Which frames join the average depends on the average, so a stream's narrow rows are walked in order."""

    def step(s: list, v: float | None) -> tuple:
        before = s[0]
        if v is None or not math.isfinite(v):
            return False, before
        bad = v < floor or (before is not None and v < before - drop)
        if not bad:
            s[0] = v if before is None else alpha * v + (1.0 - alpha) * before
        return bad, before

    return ordered_fold(frames, key, [order], [psnr], lambda: [None], step, "bad boolean, baseline double")
