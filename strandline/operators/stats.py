"""Measurements: cell means, winners, profiles, costs, slopes, curves, truth sets, ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_cube(scores: DataFrame) -> DataFrame:
    """Count, sum and mean of the metric for every subset of (win, degrade), by model; level tells which are set."""
    own = scores.cube("win", "degrade", "model").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("metric").alias("total"), F.avg("metric").alias("mean")
    )
    return own.where("level % 2 = 0")


def winner(a: Column, b: Column, band: float = 0.03, relative: bool = True) -> Column:
    """a, b or tie: a difference under the band (of the larger one, or absolute) is a tie; lower is better."""
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) if relative else F.abs(a - b)
    return F.when(gap < band, "tie").when(a < b, "a").otherwise("b")


def profile(events: DataFrame) -> DataFrame:
    """events (component, ptype, frame_idx, ms): mean ms per frame of each component by type and over all; a missing component counts as 0."""
    per = events.groupBy("frame_idx", "ptype", "component").agg(F.sum("ms").alias("ms"))
    frames = events.groupBy("frame_idx", "ptype").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    sums = per.groupBy("component", "ptype").agg(F.sum("ms").alias("ms"))
    counts = frames.groupBy("ptype").agg(F.count(F.lit(1)).alias("frames"))  # a row a type
    dense = sums.select("component").distinct().crossJoin(F.broadcast(counts)).join(sums, ["component", "ptype"], "left").fillna(0.0, ["ms"])
    return dense.groupingSets([["component", "ptype"], ["component"]], "component", "ptype").agg((F.sum("ms") / F.sum("frames")).alias("mean_ms"), F.sum("frames").alias("frames"))


def cost_account(frames: DataFrame, key: list[str], ms_anchor: float, ms_frame: float) -> DataFrame:
    """Anchors, sum of holes of the other frames, full-frame equivalents, their share of the frames, ms a frame and frames a second."""
    hole = F.when(~F.col("is_anchor"), F.col("hole"))
    out = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anchor").cast("int")).alias("anchors"), F.coalesce(F.sum(hole), F.lit(0.0)).alias("holes"))
    out = out.withColumn("equivalents", F.col("anchors") + F.col("holes")).withColumn("share", F.col("equivalents") / F.col("n"))
    ms = F.col("share") * ms_anchor + F.lit(ms_frame)
    return out.withColumn("ms", ms).withColumn("fps", F.when(F.col("ms") > 0, 1000.0 / F.col("ms")).otherwise(F.lit(float("inf"))))


def within_of_best(points: DataFrame, key: list[str], quality: str, cost: str, within: float = 1.0) -> DataFrame:
    """Per group the cheapest point whose quality is within `within` of the best one's; ties by the point's name."""
    best = F.max(quality).over(Window.partitionBy(*key))
    return points.withColumn("__best", best).where(F.col(quality) >= F.col("__best") - within).groupBy(*key).agg(F.min_by(F.struct("point", quality, cost), F.struct(cost, "point")).alias("p")).select(*key, "p.*")


def slope(rows: DataFrame, key: list[str], x: str, y: str, skip: float = 0.3) -> DataFrame:
    """Least-squares slope of y over x on the rows from `skip` of the largest x on; null under two distinct x."""
    most = F.max(x).over(Window.partitionBy(*key))
    used = rows.withColumn("__most", most).where(F.col(x) >= skip * F.col("__most"))
    return used.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n"))


def half_life(curve: DataFrame, key: list[str], x: str = "dist", y: str = "gap") -> DataFrame:
    """First x where y falls to half its first value, between points by a line; the last x if it never does; null if it starts at 0 or less."""
    order = Window.partitionBy(*key).orderBy(x)
    p = curve.withColumn("g0", F.first(y).over(order)).withColumn("px", F.lag(x).over(order)).withColumn("py", F.lag(y).over(order))
    half = F.col("g0") / 2
    at = F.when(F.col("px").isNull() | (F.col("py") == F.col(y)), F.col(x).cast("double")).otherwise(F.col("px") + (F.col("py") - half) / (F.col("py") - F.col(y)) * (F.col(x) - F.col("px")))
    out = p.groupBy(*key).agg(F.min(F.when(F.col(y) <= half, F.struct(F.col(x), at.alias("at")))).alias("hit"), F.max(x).cast("double").alias("last"), F.first("g0").alias("g0"))
    return out.select(*key, F.when(F.col("g0") <= 0, None).otherwise(F.coalesce("hit.at", "last")).alias("half_life"))


def truth_scores(found: DataFrame, expected: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall of found against expected rows; empty sets count as one."""
    a, b = found.select(*on).distinct().withColumn("f", F.lit(1)), expected.select(*on).distinct().withColumn("e", F.lit(1))
    both = a.join(b, on, "full_outer")
    f, e = F.col("f").isNotNull(), F.col("e").isNotNull()
    out = both.groupBy(*key).agg(F.count_if(f & e).alias("tp"), F.count_if(f & ~e).alias("fp"), F.count_if(e & ~f).alias("fn"))
    rate = lambda x: F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col(x))
    return out.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))


def merged(*streams: DataFrame) -> DataFrame:
    """Rows of timed streams in one order: time, then rank; a range sort, so no task holds a stream."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy("t", "rank", "id")


def lookup(points: DataFrame, xs: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Piecewise-linear value of a curve at each xs.at, flat outside its ends; curves and places share one sort."""
    own = points.select(*key, F.col(x).cast("double").alias("p"), F.col(y).cast("double").alias("v"), F.lit(True).alias("on"))
    ask = xs.select(*key, F.col("at").cast("double").alias("p"), F.lit(None).cast("double").alias("v"), F.lit(False).alias("on"))
    order = Window.partitionBy(*key).orderBy("p", F.col("on").desc())
    lo = F.last(F.when(F.col("on"), F.struct("p", "v")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hi = F.first(F.when(F.col("on"), F.struct("p", "v")), ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    b = own.unionByName(ask).withColumn("lo", lo).withColumn("hi", hi).where("not on")
    line = F.col("lo.v") + (F.col("p") - F.col("lo.p")) / (F.col("hi.p") - F.col("lo.p")) * (F.col("hi.v") - F.col("lo.v"))
    return b.select(*key, F.col("p").alias("at"), F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull() | (F.col("lo.p") == F.col("p")), F.col("lo.v")).otherwise(line).alias("value"))


def calmest_window(frames: DataFrame, key: str, size: int, luma: str = "diff", chroma: str | None = None) -> DataFrame:
    """Per clip the start of the run of `size` frames whose largest luma step plus half its largest chroma step is least."""
    ahead = Window.partitionBy(key).orderBy("frame_idx").rowsBetween(1, size - 1)
    cost = F.max(luma).over(ahead) + (0.5 * F.max(chroma).over(ahead) if chroma else F.lit(0.0))
    own = frames.withColumn("cost", cost).withColumn("have", F.count(F.lit(1)).over(ahead)).where(F.col("have") == size - 1)
    return own.groupBy(key).agg(F.min(F.struct("cost", "frame_idx")).alias("b")).select(key, F.col("b.frame_idx").alias("start"), F.col("b.cost").alias("cost"))


def before_after(rows: DataFrame, key: list[str], base: str = "before") -> DataFrame:
    """Per variant: number, mean, median and ninth decile of ms, and the mean quality against the base variant's on the same key."""
    ref = rows.where(F.col("variant") == base).select(*key, F.col("quality").alias("__base"))
    own = rows.join(ref, key).withColumn("delta", F.col("quality") - F.col("__base"))
    return own.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.median("ms").alias("median_ms"), F.percentile("ms", 0.9).alias("p90_ms"), F.avg("delta").alias("quality_delta")
    )
