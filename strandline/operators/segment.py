"""Scene cuts, segments, chunks and islands of a frame stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold


@dataclass(frozen=True)
class CutRules:
    """Limits of the cut rules; a chroma dominance of 0 turns the chroma rule off."""

    absolute: float = 60.0
    intra: float = 45.0
    floor: float = 40.0
    times: float = 8.0
    gap: int = 24
    alpha: float = 0.30
    chroma_absolute: float = 60.0
    chroma_floor: float = 22.0
    chroma_times: float = 6.0
    dominance: float = 1.1


class CutState:
    """What the detector remembers of a stream: planes of the last frame, two baselines, the last cut."""

    __slots__ = ("luma", "chroma", "base", "chroma_base", "last")

    def __init__(self) -> None:
        self.luma = self.chroma = self.base = self.chroma_base = None
        self.last = 0


def cut_step(rules: CutRules):
    """A fold step over (frame_idx, ptype, luma, chroma): (diff, is_cut, fired_by).

    chroma is None where the stream has no chroma plane.  The first frame has no difference.
    """

    def folded(base: float | None, d: float) -> float:
        return d if base is None else rules.alpha * d + (1.0 - rules.alpha) * base

    def step(s: CutState, idx: int, kind: str, luma: float, chroma: float | None) -> tuple:
        before, before_c, s.luma, s.chroma = s.luma, s.chroma, luma, chroma
        if before is None:
            s.last = idx
            return None, False, None
        d = abs(luma - before)
        dc = abs(chroma - before_c) if chroma is not None and before_c is not None else 0.0
        tests = (
            ("absolute", d > rules.absolute),
            ("intra", kind == "I" and d > rules.intra),
            ("relative", s.base is not None and d > rules.floor and d > rules.times * s.base),
            ("chroma", rules.dominance > 0 and dc > rules.dominance * d and (dc > rules.chroma_absolute or (s.chroma_base is not None and dc > rules.chroma_floor and dc > rules.chroma_times * s.chroma_base))),
        )
        fired = next((name for name, hit in tests if hit), None)
        if fired and idx - s.last >= rules.gap:
            s.last, s.base, s.chroma_base = idx, None, None
            return d, True, fired
        s.base, s.chroma_base = folded(s.base, d), folded(s.chroma_base, dc)
        return d, False, fired

    return step


def scene_cuts(frames: DataFrame, rules: CutRules = CutRules(), chroma: str | None = None) -> DataFrame:
    """frames with diff, is_cut and fired_by (the rule that held, cut or not)."""
    own = frames.withColumn("__chroma", F.col(chroma).cast("double") if chroma else F.lit(None).cast("double"))
    return ordered_fold(own, "clip_id", ["frame_idx"], ["frame_idx", "ptype", "luma", "__chroma"], CutState, cut_step(rules), "diff double, is_cut boolean, fired_by string").drop("__chroma")


def with_scene(cut_frames: DataFrame) -> DataFrame:
    """scene: how many cuts stand at or before the frame in its clip."""
    upto = Window.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut_frames.withColumn("scene", F.sum(F.col("is_cut").cast("int")).over(upto).cast("int"))


def segments(cut_frames: DataFrame, least: int = 24) -> DataFrame:
    """clip_id, sid, s0, s1: half-open scenes; a short segment other than the first joins the one before."""
    raw = with_scene(cut_frames).groupBy("clip_id", "scene").agg(F.min("frame_idx").alias("s0"), (F.max("frame_idx") + 1).alias("s1"))
    order = Window.partitionBy("clip_id").orderBy("s0")
    kept = raw.withColumn("sid", F.sum(((F.col("scene") == 0) | (F.col("s1") - F.col("s0") >= least)).cast("int")).over(order) - 1)
    return kept.groupBy("clip_id", F.col("sid").cast("int").alias("sid")).agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"))


def scene_of(frames: DataFrame, segs: DataFrame) -> DataFrame:
    """frames with the sid of the segment that holds them, the last one where none does.

    The starts of segments and the frames share one window per clip, so no range join is made.
    """
    marks = segs.select("clip_id", F.col("s0").alias("frame_idx"), F.lit(0).alias("__kind"), "sid")
    own = frames.withColumn("__kind", F.lit(1)).withColumn("sid", F.lit(None).cast("int"))
    upto = Window.partitionBy("clip_id").orderBy("frame_idx", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = own.unionByName(marks, allowMissingColumns=True)
    return both.withColumn("sid", F.last("sid", ignorenulls=True).over(upto)).where("__kind = 1").drop("__kind")


def gop_chunks(cut_frames: DataFrame, soft_cap: int = 48) -> DataFrame:
    """chunk_id of each frame: a chunk begins at an I frame, at a cut, or at a P frame once it holds soft_cap frames."""

    def step(s: list, kind: str, cut: bool) -> tuple:
        if s[1] and (kind == "I" or cut or (s[1] >= soft_cap and kind == "P")):
            s[0], s[1] = s[0] + 1, 0
        s[1] += 1
        return s[0], s[1] - 1

    return ordered_fold(cut_frames, "clip_id", ["frame_idx"], ["ptype", "is_cut"], lambda: [0, 0], step, "chunk_id int, place int")


def islands(frames: DataFrame, value: str) -> DataFrame:
    """run: number of the run of equal values that the frame stands in."""
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(order))) & F.lag("frame_idx").over(order).isNotNull(), F.lit(False))
    return frames.withColumn("run", F.sum(new.cast("int")).over(order).cast("int"))
