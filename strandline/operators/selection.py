"""Picking frames and comparing variants: gates, skip sets, holds, samples, sweeps, equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gated_records(mvs: DataFrame, gates: DataFrame, grid_w: int, grid_h: int, limit: float = 0.5) -> DataFrame:
    """Records whose block centre, held inside the grid, lies on background (gate under the limit).

    gates: frame_id, y, x, gate.  A frame without a gate at that place counts as background.  Gates that are made from the records
    themselves don't need a table of cells: see motion.covered_centres.
    """
    own = mvs.withColumn("y", F.least(F.greatest("dst_y", F.lit(0)), F.lit(grid_h - 1))).withColumn("x", F.least(F.greatest("dst_x", F.lit(0)), F.lit(grid_w - 1)))
    return on_background(own.join(gates, ["frame_id", "y", "x"], "left"), F.col("gate"), limit)


def on_background(records: DataFrame, gate: Column, limit: float = 0.5) -> DataFrame:
    """Records whose gate is under the limit; those without one count as background."""
    return records.where(F.coalesce(gate, F.lit(0.0)) < limit)


def without(frames: DataFrame, skip: DataFrame, on: list[str]) -> DataFrame:
    """Frames that are not in the skip set."""
    return frames.join(skip.select(*on).distinct(), on, "left_anti")


def floor_promotions(frames: DataFrame, quality: str, floor: float, key: str = "clip_id") -> DataFrame:
    """P frames whose quality is under the floor; the first backbone frame is never one."""
    first = F.min(F.when(F.col("ptype").isin("I", "P"), F.col("frame_idx"))).over(Window.partitionBy(key))
    return frames.withColumn("__f", first).where((F.col("ptype") == "P") & (F.col("frame_idx") != F.col("__f")) & (F.col(quality) < floor)).drop("__f")


def held(frames: DataFrame, value: str, every: int, key: str = "clip_id") -> DataFrame:
    """value of the first frame of each run of `every` frames, for all of them."""
    run = Window.partitionBy(key, F.floor(F.col("frame_idx") / every)).orderBy("frame_idx")
    return frames.withColumn("held", F.first(value).over(run))


def k_samples(frames: DataFrame, k: int, key: str = "clip_id") -> DataFrame:
    """Every n//k-th frame of a clip of n, the first k of them."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    place = F.row_number().over(order) - 1
    step = F.greatest(F.floor(n / k), F.lit(1))
    return frames.withColumn("__p", place).withColumn("__s", step).where("__p % __s = 0").where(F.col("__p") / F.col("__s") < k).drop("__p", "__s")


def hidden_cut(samples: DataFrame, value: str, size: str, limit: float = 18.0, key: str = "clip_id") -> DataFrame:
    """Per clip the largest step between neighbouring samples (255 where the size changes) and whether it exceeds the limit."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    before = F.lag(F.struct(F.col(value).alias("v"), F.col(size).alias("s"))).over(order)
    step = F.when(before["s"] != F.col(size), F.lit(255.0)).otherwise(F.abs(F.col(value) - before["v"]))
    out = samples.withColumn("__d", F.when(before.isNotNull(), step)).groupBy(key).agg(F.coalesce(F.max("__d"), F.lit(0.0)).alias("largest"))
    return out.withColumn("suspected", F.col("largest") > limit)


def cadence(frames: DataFrame, nmv: str, every: int) -> DataFrame:
    """fresh: a frame without motion records or on every n-th place; the others are warped."""
    return frames.withColumn("fresh", (F.coalesce(F.col(nmv), F.lit(0)) == 0) | (F.col("frame_idx") % every == 0))


def threshold_sweep(frames: DataFrame, value: str, limits: list[float], key: list[str]) -> DataFrame:
    """For each limit and group: how often the value exceeds it and its mean where it does; limits are a short list."""
    rows = frames.withColumn("limit_at", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    over = F.col(value) > F.col("limit_at")
    return rows.groupBy(*key, "limit_at").agg(F.avg(over.cast("double")).alias("fire_rate"), F.avg(F.when(over, F.col(value))).alias("mean_over"))


def variant_table(rows: DataFrame, variant: Column, metric: str, base: str) -> DataFrame:
    """Mean, median and ninth decile of a metric by variant, and the mean's distance to the base variant's."""
    own = rows.groupBy(variant.alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("middle"), F.percentile(metric, 0.9).alias("p90"))
    ref = own.where(F.col("variant") == base).select(F.col("mean").alias("__base"))
    return own.crossJoin(F.broadcast(ref)).withColumn("delta", F.col("mean") - F.col("__base")).drop("__base")  # one row


def latency_stats(rows: DataFrame, key: list[str], order: str, ms: str) -> DataFrame:
    """Last, mean, median and number of measurements of each group."""
    return rows.groupBy(*key).agg(F.max_by(ms, order).alias("last_ms"), F.avg(ms).alias("mean_ms"), F.median(ms).alias("median_ms"), F.count(ms).alias("n"))


def tile_coverage(tiles: DataFrame, value: str, key: list[str], eps: float) -> DataFrame:
    """Per group of tiles: how many they are and the share with a value above eps."""
    return tiles.groupBy(*key).agg(F.count(F.lit(1)).alias("tiles"), F.avg((F.col(value) > eps).cast("double")).alias("share"))


def unequal(a: DataFrame, b: DataFrame, key: str, exact: list[str], close: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per key whether two signal tables agree: discrete columns exactly, doubles within the tolerance, NaN and null as equals; missing keys don't."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    clean = lambda v: F.when(F.isnan(v), None).otherwise(v)
    near = lambda c: F.coalesce(F.abs(clean(x(c)) - clean(y(c))) <= tolerance, clean(x(c)).isNull() & clean(y(c)).isNull())
    same = x(key).isNotNull() & y(key).isNotNull()
    for c in exact:
        same = same & x(c).eqNullSafe(y(c))
    for c in close:
        same = same & near(c)
    return both.select(F.coalesce(x(key), y(key)).alias(key), same.alias("same"))
