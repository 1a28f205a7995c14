"""Table functions: a producer of pictures, a plate's motion and a soft policy, chosen by name and called from SQL.

Each one works along a clip (or a place) whose rows Spark deals to it by PARTITION BY and in order of the frames:

    SELECT * FROM produce(TABLE(frames) PARTITION BY clip ORDER BY frame_idx, producer => 'propagated', side => 8, scale => 2)

What may be named is in the registries below, which take others too.  ``analyze`` checks names, options and
columns before a task runs.  State is what a producer keeps of a clip: a picture or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import kernels

PICTURE = "clip long, frame_idx long, source string, picture array<double>"
VIEW = "clip long, frame_idx long, picture array<double>"
SOFT = "clip long, pos int, frame_idx long, value double"


class Single:
    """Every frame upscaled alone."""

    def frame(self, ptype: str, plane: np.ndarray, dx: np.ndarray, dy: np.ndarray, scale: int) -> tuple[str, np.ndarray]:
        return "upscaled", kernels.resized(plane, plane.shape[0] * scale, plane.shape[1] * scale)


class Held:
    """I frames (and a clip's first) upscaled and shown until the next one."""

    def __init__(self) -> None:
        self.shown: np.ndarray | None = None

    def frame(self, ptype, plane, dx, dy, scale) -> tuple[str, np.ndarray]:
        if ptype == "I" or self.shown is None:
            self.shown = kernels.resized(plane, plane.shape[0] * scale, plane.shape[1] * scale)
            return "upscaled", self.shown
        return "held", self.shown


class Propagated:
    """I frames (and a clip's first) upscaled; the others warped from the picture before along their vectors, upscaled where they have none."""

    def __init__(self) -> None:
        self.before: np.ndarray | None = None

    def frame(self, ptype, plane, dx, dy, scale) -> tuple[str, np.ndarray]:
        h, w = plane.shape[0] * scale, plane.shape[1] * scale
        up = kernels.resized(plane, h, w)
        if ptype == "I" or self.before is None:
            self.before = up
            return "upscaled", up
        big = lambda v: kernels.resized(v, h, w, "nearest")
        moved = kernels.backward_warp(self.before, big(np.nan_to_num(dx)) * scale, big(np.nan_to_num(dy)) * scale)
        self.before = np.where(big(np.isfinite(dx).astype(float)) > 0.5, moved, up)
        return "warped", self.before


PRODUCERS: dict[str, Callable[[], object]] = {"single": Single, "held": Held, "propagated": Propagated}
#: Shift (dx, dy) of a plate's view at a frame, from the frame's place in its clip and a speed.
PLATE_MOTIONS: dict[str, Callable[[int, float], tuple[float, float]]] = {
    "still": lambda k, speed: (0.0, 0.0),
    "pan": lambda k, speed: (k * speed, 0.0),
    "shake": lambda k, speed: (speed * np.sin(k * 2.1), speed * np.cos(k * 1.7)),
}
#: What a distrusted value is drawn to, from (cheap, heavy, smoothed difference of both).
POLICIES: dict[str, Callable[[float, float, float], float]] = {
    "cheap": lambda cheap, heavy, soft: cheap,
    "heavy": lambda cheap, heavy, soft: heavy,
    "smoothed": lambda cheap, heavy, soft: cheap + soft,
}


def _named(kind: str, known: dict, arg: AnalyzeArgument) -> str:
    if not arg.isConstantExpression or arg.value not in known:
        raise ValueError(f"{kind} must be one of {', '.join(sorted(known))}")
    return arg.value


def _has(arg: AnalyzeArgument, needed: str) -> None:
    if not arg.isTable:
        raise ValueError("the first argument is a table")
    missing = set(needed.split()) - {f.name for f in arg.dataType.fields}
    if missing:
        raise ValueError(f"the table lacks {', '.join(sorted(missing))}")


def _result(schema: str) -> AnalyzeResult:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "array<double>": T.ArrayType(T.DoubleType())}
    return AnalyzeResult(T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]))  # analysis has no session to parse it


def _plane(v, side: int) -> np.ndarray:
    return np.asarray(v, float).reshape(-1, side)


class Produce:
    """Pictures of the frames of a clip (clip, frame_idx, ptype, plane, mvs) by a producer."""

    @staticmethod
    def analyze(frames: AnalyzeArgument, producer: AnalyzeArgument, side: AnalyzeArgument, scale: AnalyzeArgument) -> AnalyzeResult:
        _has(frames, "clip frame_idx ptype plane mvs")
        _named("producer", PRODUCERS, producer)
        if not (isinstance(side.value, int) and isinstance(scale.value, int) and side.value > 0 and scale.value > 0):
            raise ValueError("side and scale are whole numbers above 0")
        return _result(PICTURE)

    def __init__(self) -> None:
        self.own = None

    def eval(self, frames, producer: str, side: int, scale: int) -> Iterator[tuple]:
        if self.own is None:
            self.own = PRODUCERS[producer]()
        plane = _plane(frames["plane"], side)
        names = ("w", "h", "dst_x", "dst_y", "motion_x", "motion_y", "motion_scale")
        records = np.array([[m[c] for c in names] for m in frames["mvs"] or []]).reshape(-1, 7)
        source, picture = self.own.frame(frames["ptype"], plane, *kernels.painted(records, *plane.shape), scale)
        yield frames["clip"], frames["frame_idx"], source, picture.ravel().tolist()


class PlateView:
    """Views of a clip's plate at its frames (clip, frame_idx, plate) under a motion."""

    @staticmethod
    def analyze(frames: AnalyzeArgument, motion: AnalyzeArgument, speed: AnalyzeArgument, side: AnalyzeArgument) -> AnalyzeResult:
        _has(frames, "clip frame_idx plate")
        _named("motion", PLATE_MOTIONS, motion)
        return _result(VIEW)

    def __init__(self) -> None:
        self.k = 0

    def eval(self, frames, motion: str, speed: float, side: int) -> Iterator[tuple]:
        plate = _plane(frames["plate"], side)
        dx, dy = PLATE_MOTIONS[motion](self.k, float(speed))
        self.k += 1
        full = lambda v: np.full(plate.shape, v)
        yield frames["clip"], frames["frame_idx"], kernels.backward_warp(plate, full(dx), full(dy)).ravel().tolist()


class Soften:
    """Values of a place along a clip (clip, pos, frame_idx, cheap, heavy, value, anchor, run, trust), drawn to what a policy says.

    The difference heavy - cheap is smoothed over the frames that run, anew from each anchor; a frame that runs and is no anchor is
    drawn by gain * trust, the others keep their value."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, policy: AnalyzeArgument, gain: AnalyzeArgument, beta: AnalyzeArgument) -> AnalyzeResult:
        _has(rows, "clip pos frame_idx cheap heavy value anchor run trust")
        _named("policy", POLICIES, policy)
        return _result(SOFT)

    def __init__(self) -> None:
        self.soft: float | None = None

    def eval(self, rows, policy: str, gain: float, beta: float) -> Iterator[tuple]:
        if rows["anchor"]:
            self.soft = None
        gap, out = rows["heavy"] - rows["cheap"], rows["value"]
        if rows["run"]:
            self.soft = gap if self.soft is None else (1 - float(beta)) * gap + float(beta) * self.soft
            if not rows["anchor"]:
                a = min(max(float(gain) * rows["trust"], 0.0), 1.0)
                out = min(max((1 - a) * out + a * POLICIES[policy](rows["cheap"], rows["heavy"], self.soft), 0.0), 255.0)
        yield rows["clip"], rows["pos"], rows["frame_idx"], float(out)


def registered(spark: SparkSession) -> None:
    """Makes produce, plate_view and soften known to SQL."""
    for name, handler in (("produce", Produce), ("plate_view", PlateView), ("soften", Soften)):
        spark.udtf.register(name, udtf(handler))
