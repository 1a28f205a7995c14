"""Pixel work on tiles kept as rows (scene, frame_idx, pos, luma): medians, metrics, blends, warps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .choice import medians
from .refs import ema

SIDE = 8


def plate_median(tiles: DataFrame, gate: Column, min_samples: int = 1) -> DataFrame:
    """Per scene and position: median luma over the frames where the gate is open, how many they are, hole if too few.

    A hole takes the median over all frames.  plate is cut to whole levels.
    """
    by = ["scene", "pos"]
    every = tiles.groupBy(*by).agg(F.count(F.when(gate, F.col("luma"))).alias("coverage")).withColumn("hole", F.col("coverage") < min_samples)
    seen = medians(tiles, by, F.when(gate, F.col("luma")), "m").drop("n")
    # few places have too few samples: only their rows are looked at again
    poor = tiles.join(every.where("hole").select(*by), by, "left_semi")
    rest = medians(poor, by, F.col("luma"), "every").drop("n")
    out = every.join(seen, by, "left").join(rest, by, "left").withColumn("value", F.when(F.col("hole"), F.col("every")).otherwise(F.col("m")))
    return out.select("scene", "pos", "value", "coverage", "hole", F.col("value").cast("int").alias("plate"))


def coverage_report(plate: DataFrame) -> DataFrame:
    """Per scene: percentages of positions seen once, three and five times, of holes, largest and median coverage."""
    share = lambda c: 100.0 * F.avg(c.cast("int"))
    c = F.col("coverage")
    return plate.groupBy("scene").agg(
        share(c >= 1).alias("pct_1"), share(c >= 3).alias("pct_3"), share(c >= 5).alias("pct_5"), share(F.col("hole")).alias("pct_hole"),
        F.max(c).alias("most"), F.median(c).alias("middle"),
    )


def psnr_of(mse: Column, floor: float = 1e-12, same: float = float("inf")) -> Column:
    """10 log10(255**2 / mse); `same` where the error is at most `floor`."""
    return F.when(mse <= floor, F.lit(same)).otherwise(10 * F.log10(F.lit(65025.0) / mse))


def psnr_pairs(a: DataFrame, b: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """PSNR of two sets of tiles over the positions that both have, per group of `key`."""
    both = a.select(*on, F.col("luma").alias("la")).join(b.select(*on, F.col("luma").alias("lb")), on)
    d = F.col("la") - F.col("lb")
    return both.groupBy(*key).agg(F.avg(d * d).alias("mse"), F.count(F.lit(1)).alias("n")).withColumn("psnr", psnr_of(F.col("mse")))


def temporal_change(tiles: DataFrame, mask: Column | None = None) -> DataFrame:
    """Per frame: mean |difference| to the frame before in its scene, inside the mask."""
    order = Window.partitionBy("scene", "pos").orderBy("frame_idx")
    d = F.abs(F.col("luma") - F.lag("luma").over(order))
    own = tiles.withColumn("d", F.when(mask, d) if mask is not None else d)
    return own.groupBy("scene", "frame_idx").agg(F.avg("d").alias("change"), F.count("d").alias("n"))


def union_mask(tiles: DataFrame, value: Column) -> DataFrame:
    """Largest value of each position over the frames of a scene."""
    return tiles.groupBy("scene", "pos").agg(F.max(value).alias("alpha"))


def blended(a: Column, b: Column, beta: Column | float) -> Column:
    """a + beta (b - a), rounded half to even and cut to 0..255."""
    return F.least(F.greatest(F.bround(a + beta * (b - a)), F.lit(0.0)), F.lit(255.0))


def composed(fg: Column, plate: Column, alpha: Column) -> Column:
    """alpha fg + (1 - alpha) plate, cut to whole levels."""
    return (alpha * fg + (1.0 - alpha) * plate).cast("int")


def downscaled(tiles: DataFrame, factor: int, side: int = SIDE) -> DataFrame:
    """Mean of each factor x factor square."""
    y, x = F.floor(F.col("pos") / side), F.col("pos") % side
    cell = (F.floor(y / factor) * (side // factor) + F.floor(x / factor)).cast("int")
    return tiles.groupBy("scene", "frame_idx", cell.alias("cell")).agg(F.avg("luma").alias("luma"))


def warped(tiles: DataFrame, vectors: DataFrame, side: int = SIDE) -> DataFrame:
    """Bilinear sample of each tile at (x + dx, y + dy), the border repeated; vectors: frame_idx, dx, dy (absent: 0).

    The four neighbours come from one join on their positions.
    """
    v = tiles.select("scene", "frame_idx", "pos").join(vectors, "frame_idx", "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(side - 1.0))
    v = v.withColumn("sx", clip(F.col("pos") % side + F.coalesce("dx", F.lit(0.0)))).withColumn("sy", clip(F.floor(F.col("pos") / side) + F.coalesce("dy", F.lit(0.0))))
    v = v.withColumn("x0", F.floor("sx")).withColumn("y0", F.floor("sy")).withColumn("fx", F.col("sx") - F.col("x0")).withColumn("fy", F.col("sy") - F.col("y0"))
    tap = lambda ox, oy, w: F.struct(
        (F.least(F.col("y0") + oy, F.lit(side - 1)) * side + F.least(F.col("x0") + ox, F.lit(side - 1))).cast("int").alias("at"), w.alias("weight")
    )
    fx, fy = F.col("fx"), F.col("fy")
    taps = v.withColumn("t", F.explode(F.array(tap(0, 0, (1 - fx) * (1 - fy)), tap(1, 0, fx * (1 - fy)), tap(0, 1, (1 - fx) * fy), tap(1, 1, fx * fy))))
    src = tiles.select("scene", "frame_idx", F.col("pos").alias("at"), "luma")
    met = taps.select("scene", "frame_idx", "pos", "t.at", "t.weight").join(src, ["scene", "frame_idx", "at"])
    return met.groupBy("scene", "frame_idx", "pos").agg(F.sum(F.col("weight") * F.col("luma")).alias("luma"))


def residual_added(tiles: DataFrame, vectors: DataFrame, step: float = 2.0, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, pos, luma, moved and value of every frame with one before it in its scene: the frame before moved along the vectors, plus
    what it lacks in whole steps, cut to levels."""
    order = Window.partitionBy("scene").orderBy("frame_idx")
    links = tiles.select("scene", "frame_idx").distinct().withColumn("before", F.lag("frame_idx").over(order)).where("before is not null")
    prev = tiles.select("scene", F.col("frame_idx").alias("before"), "pos", "luma").join(links, ["scene", "before"]).select("scene", "frame_idx", "pos", "luma")
    moved = warped(prev, vectors, side).withColumnRenamed("luma", "moved")
    both = tiles.join(moved, ["scene", "frame_idx", "pos"])
    value = F.col("moved") + F.floor((F.col("luma") - F.col("moved")) / step) * step
    return both.withColumn("value", F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)).cast("int"))


def gated(tiles: DataFrame, limit: float, size: int = 5, factor: int = 2, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, cell, luma, on and grown of tiles made smaller by `factor`: cells of `limit` or more, and those within an ellipse around one."""
    small, r = side // factor, size // 2
    cells = downscaled(tiles, factor, side).withColumn("on", F.col("luma") >= limit)
    shape = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    offsets = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in shape])
    y, x = F.floor(F.col("cell") / small) + F.col("o.dy"), F.col("cell") % small + F.col("o.dx")
    lit = cells.where("on").withColumn("o", F.explode(offsets)).where((y >= 0) & (y < small) & (x >= 0) & (x < small))
    near = lit.select("scene", "frame_idx", (y * small + x).cast("int").alias("cell")).distinct().withColumn("grown", F.lit(True))
    return cells.join(near, ["scene", "frame_idx", "cell"], "left").withColumn("grown", F.coalesce("grown", F.lit(False)))


def splatted(tiles: DataFrame, vectors: DataFrame, importance: Column, side: int = SIDE) -> DataFrame:
    """Softmax splat: each sample goes to the four cells around (x + dx, y + dy) with weight exp(importance - most); cells that get nothing are absent."""
    most = F.max("w").over(Window.partitionBy("scene", "frame_idx"))
    v = tiles.join(vectors, "frame_idx", "left").withColumn("w", importance).withColumn("e", F.exp(F.col("w") - most))
    v = v.withColumn("sx", F.col("pos") % side + F.coalesce("dx", F.lit(0.0))).withColumn("sy", F.floor(F.col("pos") / side) + F.coalesce("dy", F.lit(0.0)))
    v = v.withColumn("x0", F.floor("sx")).withColumn("y0", F.floor("sy")).withColumn("fx", F.col("sx") - F.col("x0")).withColumn("fy", F.col("sy") - F.col("y0"))
    fx, fy = F.col("fx"), F.col("fy")
    tap = lambda ox, oy, w: F.struct((F.col("x0") + ox).alias("x"), (F.col("y0") + oy).alias("y"), w.alias("share"))
    taps = v.withColumn("t", F.explode(F.array(tap(0, 0, (1 - fx) * (1 - fy)), tap(1, 0, fx * (1 - fy)), tap(0, 1, (1 - fx) * fy), tap(1, 1, fx * fy))))
    inside = taps.where(f"t.x >= 0 and t.x < {side} and t.y >= 0 and t.y < {side} and t.share > 0")
    weight = F.col("t.share") * F.col("e")
    out = inside.groupBy("scene", "frame_idx", (F.col("t.y") * side + F.col("t.x")).cast("int").alias("pos")).agg(F.sum(weight * F.col("luma")).alias("s"), F.sum(weight).alias("w"))
    return out.select("scene", "frame_idx", "pos", (F.col("s") / F.col("w")).alias("luma"))


def var_laplacian(tiles: DataFrame, side: int = SIDE, mask: Column | None = None) -> DataFrame:
    """Per frame: variance of the four-neighbour Laplacian over inner positions."""
    row = Window.partitionBy("scene", "frame_idx").orderBy("pos")
    near = F.lag("luma", 1).over(row) + F.lead("luma", 1).over(row) + F.lag("luma", side).over(row) + F.lead("luma", side).over(row)
    x, y = F.col("pos") % side, F.floor(F.col("pos") / side)
    inner = (x > 0) & (x < side - 1) & (y > 0) & (y < side - 1)
    lap = tiles.withColumn("lap", F.when(inner & (mask if mask is not None else F.lit(True)), near - 4 * F.col("luma")))
    return lap.groupBy("scene", "frame_idx").agg(F.var_pop("lap").alias("sharpness"))


def blockiness(tiles: DataFrame, side: int = SIDE, q: int = 4) -> DataFrame:
    """Per frame: mean horizontal step on the q-grid over the mean step everywhere."""
    row = Window.partitionBy("scene", "frame_idx", F.floor(F.col("pos") / side)).orderBy("pos")
    step = tiles.withColumn("step", F.abs(F.lead("luma").over(row) - F.col("luma"))).withColumn("x", F.col("pos") % side)
    return step.groupBy("scene", "frame_idx").agg((F.avg(F.when(F.col("x") % q == q - 1, F.col("step"))) / (F.avg("step") + 1e-6)).alias("blockiness"))


def patched(rows: DataFrame, skip: DataFrame, limit: float) -> DataFrame:
    """rows (scene, frame_idx, pos, hole, heavy, cheap) with value and patched: frames with a share of holes above the
    limit take the heavy value exactly inside their holes; frames of skip (scene, frame_idx) and others stay cheap."""
    key = ["scene", "frame_idx"]
    share = F.avg(F.col("hole").cast("int")).over(Window.partitionBy(*key))
    own = rows.join(skip.select(*key, F.lit(True).alias("__skip")).distinct(), key, "left").withColumn("__share", share)
    own = own.withColumn("patched", F.col("hole") & F.col("__skip").isNull() & (F.col("__share") > limit))
    return own.withColumn("value", F.when(F.col("patched"), F.col("heavy")).otherwise(F.col("cheap"))).drop("__skip", "__share")


def registered_change(tiles: DataFrame, columns: Column, side: int = SIDE) -> DataFrame:
    """Per frame: mean |difference| to the frame before in its scene moved right by whole `columns`; places that the
    frame before does not reach are left out, and frames without any are absent."""
    order = Window.partitionBy("scene").orderBy("frame_idx")
    links = tiles.select("scene", "frame_idx").distinct().withColumn("before", F.lag("frame_idx").over(order)).where("before is not null")
    x = F.col("pos") % side - columns
    own = tiles.withColumn("at", (F.col("pos") - columns).cast("int")).where((x >= 0) & (x < side)).join(links, ["scene", "frame_idx"])
    prev = tiles.select("scene", F.col("frame_idx").alias("before"), F.col("pos").alias("at"), F.col("luma").alias("old"))
    both = own.join(prev, ["scene", "before", "at"])
    return both.groupBy("scene", "frame_idx").agg(F.avg(F.abs(F.col("luma") - F.col("old"))).alias("change"), F.count(F.lit(1)).alias("n"))


def best_crop(tiles: DataFrame, size: int, stride: int, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, y, x and sharpness of the crop of each tile whose inner Laplacian varies most; the first (y, x) on ties."""
    row = Window.partitionBy("scene", "frame_idx").orderBy("pos")
    near = F.lag("luma", 1).over(row) + F.lead("luma", 1).over(row) + F.lag("luma", side).over(row) + F.lead("luma", side).over(row)
    starts = range(0, side - size + 1, stride)
    crops = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in starts for x in starts])
    lap = tiles.withColumn("lap", near - 4 * F.col("luma")).withColumn("c", F.explode(crops))
    px, py = F.col("pos") % side - F.col("c.x"), F.floor(F.col("pos") / side) - F.col("c.y")
    inner = lap.where((px >= 1) & (px <= size - 2) & (py >= 1) & (py <= size - 2))
    v = inner.groupBy("scene", "frame_idx", "c.y", "c.x").agg(F.var_pop("lap").alias("sharpness"))
    best = v.groupBy("scene", "frame_idx").agg(F.min_by(F.struct("y", "x", "sharpness"), F.struct(-F.col("sharpness"), "y", "x")).alias("b"))
    return best.select("scene", "frame_idx", "b.*")


def sampled_plate(plate: DataFrame, shift: DataFrame, side: int = SIDE) -> DataFrame:
    """scene, frame_idx, pos, value: each frame's view of its scene's plate (scene, pos, value), moved by whole dx, dy of
    shift (scene, frame_idx, dx, dy; 0 stands still), the border repeated."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(side - 1))
    rows = shift.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    at = clip(F.floor(F.col("pos") / side) + F.col("dy")) * side + clip(F.col("pos") % side + F.col("dx"))
    return rows.withColumn("at", at.cast("int")).join(plate.select("scene", F.col("pos").alias("at"), "value"), ["scene", "at"]).select("scene", "frame_idx", "pos", "value")


def agreeing(base: Column, own: Column, other: Column, gain: float) -> Column:
    """base with the other's high frequency added where both have one sign; rounded half to even and cut to 0..255."""
    out = F.when(F.signum(own) == F.signum(other), base + gain * other).otherwise(base)
    return F.least(F.greatest(F.bround(out), F.lit(0.0)), F.lit(255.0))


def layered(rows: DataFrame, plate: DataFrame, guard: DataFrame) -> DataFrame:
    """rows (scene, frame_idx, pos, luma, alpha) with value and layered: laid over the scene's plate, or kept where the
    frame's plate is bad (guard: scene, frame_idx, bad)."""
    both = rows.join(plate, ["scene", "pos"]).join(guard, ["scene", "frame_idx"])
    own = F.floor("luma").cast("double")
    value = F.when(F.col("bad"), own.cast("int")).otherwise(composed(own, F.col("plate").cast("double"), F.col("alpha")))
    return both.withColumn("value", value).withColumn("layered", ~F.col("bad"))


#: What a distrusted place is drawn to, by policy: the cheap value, the heavy one, or the cheap one with smoothed high frequencies.
SOFT_POLICIES: dict[str, Callable[[], Column]] = {
    "cheap": lambda: F.col("cheap"),
    "heavy": lambda: F.col("heavy"),
    "smoothed": lambda: F.col("cheap") + F.col("ema"),
}


def soft_patched(rows: DataFrame, policy: Callable[[], Column], gain: float = 0.6, beta: float = 0.85) -> DataFrame:
    """rows (scene, frame_idx, pos, cheap, heavy, value, anchor, run, feather, trust) with patched and soft.

    High frequencies (heavy less cheap) of each place are smoothed along the scene over the frames that
    run, anew from each anchor.  A frame that runs and is no anchor is drawn to the policy's value by
    gain * feather * trust; the others keep their value.
    """
    own = rows.withColumn("hf", F.col("heavy") - F.col("cheap"))
    own = ema(own, "hf", 1.0 - beta, reset="anchor", keep="run", key=["scene", "pos"]).withColumn("patched", F.col("run") & ~F.col("anchor"))
    a = F.least(F.greatest(gain * F.col("feather") * F.col("trust"), F.lit(0.0)), F.lit(1.0))
    drawn = F.least(F.greatest((1.0 - a) * F.col("value") + a * policy(), F.lit(0.0)), F.lit(255.0))
    return own.withColumn("soft", F.when(F.col("patched"), drawn).otherwise(F.col("value"))).drop("hf")
