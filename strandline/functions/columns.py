"""Small column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the luma of Rec. 601.
LUMA = (0.299, 0.587, 0.114)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Unrounded Rec. 601 luma."""
    return sum((c * w for c, w in zip((r, g, b), LUMA, strict=True)), F.lit(0.0))


def picture_type(code: Column) -> Column:
    """1, 2, 3 as I, P, B; anything else, null too, as ?."""
    return F.when(code == 1, "I").when(code == 2, "P").when(code == 3, "B").otherwise("?")


def seconds(pts: Column, num: Column, den: Column) -> Column:
    """pts in a time base as seconds; null pts are 0."""
    return F.coalesce(F.try_divide((pts * num).cast("double"), den.cast("double")), F.lit(0.0))


def frame_rate(average: Column, base: Column, guessed: Column) -> Column:
    """The first rate that is known, as struct<num, den>; 25/1 if none is."""
    return F.coalesce(average, base, guessed, F.struct(F.lit(25).alias("num"), F.lit(1).alias("den")))


def frame_count(stated: Column, duration: Column, fps: Column, most: Column | None = None) -> Column:
    """Frames of a container: the stated number, else the rounded duration times the rate, 0 if unknown; at most `most`."""
    n = F.when(stated > 0, stated).otherwise(F.coalesce(F.bround(duration * fps).cast("bigint"), F.lit(0)))
    return F.least(n, most) if most is not None else n


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 up to lo, 1 from hi on, a line between."""
    return F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def motion_gate(mag: Column, lo: float, hi: float) -> Column:
    """1 on still pixels, 0 from hi on."""
    return 1.0 - ramp(mag, lo, hi)


def adaptive_beta(sharp: Column, degraded: Column, sharp_span: tuple[float, float], degraded_span: tuple[float, float], top: float = 0.85, depth: float = 0.15) -> Column:
    """top less depth times both ramps."""
    return top - depth * ramp(sharp, *sharp_span) * ramp(degraded, *degraded_span)


def occluded(forward_x: Column, forward_y: Column, back_x: Column, back_y: Column, share: float = 0.01, floor: float = 0.5) -> Column:
    """Forward and backward vectors that don't cancel: the pixel is covered in one of the frames."""
    gap = (forward_x + back_x) * (forward_x + back_x) + (forward_y + back_y) * (forward_y + back_y)
    size = forward_x * forward_x + forward_y * forward_y + back_x * back_x + back_y * back_y
    return gap > share * size + floor


def clamped(value: Column, mean: Column, std: Column, gamma: float) -> Column:
    """value held within gamma deviations of the mean, rounded half to even; an infinite gamma changes nothing."""
    return value if gamma == float("inf") else F.bround(F.least(F.greatest(value, mean - gamma * std), mean + gamma * std))


def even_sample(s0: Column, s1: Column, most: int) -> Column:
    """At most `most` evenly spaced frame numbers of [s0, s1), as an array."""
    n = s1 - s0
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: (s0 + F.floor(k * n / F.lit(float(most)))).cast("bigint"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= most, F.sequence(s0.cast("bigint"), s1.cast("bigint") - 1)).otherwise(F.array_distinct(spread))


def layered_cost(n: Column, sample: float, matte: float, refresh: Column, fg: float, composite: float, grain: float, plate: float) -> Column:
    """ms a frame of the layered mode: per frame work, a matte every `refresh` frames, one plate a scene."""
    return sample + matte / refresh + fg + composite + grain + plate / n


def beta_maps(texture: Column, detail: Column, disagreement: Column, texture_span: tuple[float, float], detail_span: tuple[float, float], gap_span: tuple[float, float], floor: float) -> dict[str, Column]:
    """Blend factors from `floor` to 1: high on texture; low only where it is smooth and detail is left; low only where it is smooth and both agree."""
    rough = ramp(texture, *texture_span)
    return {
        "by_texture": floor + (1.0 - floor) * rough,
        "by_degradation": 1.0 - (1.0 - rough) * ramp(detail, *detail_span) * (1.0 - floor),
        "by_disagreement": 1.0 - (1.0 - rough) * (1.0 - ramp(disagreement, *gap_span)) * (1.0 - floor),
    }
