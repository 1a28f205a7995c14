"""References between frames: neighbours on the I/P backbone, anchors, drift, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def on_backbone(ptype: str = "ptype") -> Column:
    return F.col(ptype).isin("I", "P")


def reference_links(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """prev_ref and next_ref (nearest backbone frames, as-of), and the weights of a blend by distance."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    idx = F.when(on_backbone(), F.col("frame_idx"))
    prev = F.last(idx, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(idx, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    linked = frames.withColumn("prev_ref", prev).withColumn("next_ref", after)
    dp, df = F.col("frame_idx") - F.col("prev_ref"), F.col("next_ref") - F.col("frame_idx")
    w_prev = F.when(dp.isNull() & df.isNull(), None).when(df.isNull(), F.lit(1.0)).when(dp.isNull(), F.lit(0.0)).otherwise(df / (dp + df))
    return linked.withColumn("w_prev", w_prev).withColumn("w_next", 1.0 - F.col("w_prev"))


def forced_anchors(frames: DataFrame, key: list[str], every: int | None = None) -> DataFrame:
    """is_anchor: an I frame, the first backbone frame of the group, or each `every`-th backbone frame (None or 0: none of these)."""
    by = Window.partitionBy(*key)
    place = F.when(on_backbone(), F.sum(on_backbone().cast("int")).over(by.orderBy("frame_idx")) - 1)
    first = F.col("frame_idx") == F.min(F.when(on_backbone(), F.col("frame_idx"))).over(by)
    marked = (F.col("ptype") == "I") | F.coalesce(first, F.lit(False))
    if every:
        marked = marked | F.coalesce(place % every == 0, F.lit(False))
    return frames.withColumn("backbone_pos", place.cast("int")).withColumn("is_anchor", marked)


def drift_distance(anchored: DataFrame, key: str = "clip_id") -> DataFrame:
    """hops: backbone frames since the last anchor; shown_distance: the same on the backbone, the display index on B frames."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    own = anchored.withColumn("__b", F.coalesce(F.sum(on_backbone().cast("int")).over(order), F.lit(0)))
    # backbone frames before the last anchor, so that hops need no group of their own and no other sort
    before = F.when(F.col("is_anchor"), F.col("__b") - F.coalesce(on_backbone(), F.lit(False)).cast("int"))
    hops = F.col("__b") - F.coalesce(F.last(before, ignorenulls=True).over(order), F.lit(0)) - 1
    own = own.withColumn("hops", F.when(on_backbone(), hops).cast("int"))
    return own.withColumn("shown_distance", F.when(F.col("ptype") == "B", F.col("frame_idx")).otherwise(F.col("hops"))).drop("__b")


def anchor_grid(frames: DataFrame, every: list[int], key: str = "clip_id") -> DataFrame:
    """frames with is_anchor_k and hops_k for each k of `every`, as forced_anchors and drift_distance give them, all from one sort of a clip."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    own = frames.withColumn("__b", F.sum(on_backbone().cast("int")).over(order))
    marks = {f"is_anchor_{k}": (F.col("ptype") == "I") | F.coalesce(on_backbone() & ((F.col("__b") - 1) % k == 0), F.lit(False)) for k in every}
    own = own.withColumns(marks)
    hops = {f"hops_{k}": F.when(on_backbone(), F.col("__b") - F.last(F.when(F.col(f"is_anchor_{k}"), F.col("__b")), ignorenulls=True).over(order)).cast("int") for k in every}
    return own.withColumns(hops).drop("__b")


def budget_anchors(frames: DataFrame, hole: str, budget: float, block: int = scan.BLOCK) -> DataFrame:
    """promoted and spent: the share of holes adds up along the backbone and promotes a frame when it reaches the budget.

    I frames and the first backbone frame reset the sum; B frames pass it on unchanged.  A clip may be cut into blocks over several tasks.
    """
    own = frames.where(on_backbone()).withColumn("__forced", F.col("ptype") == "I")
    out = scan.budget(own, ["clip_id"], "frame_idx", hole, "__forced", budget, block).drop("__forced")
    rest = frames.where(~F.coalesce(on_backbone(), F.lit(False))).withColumn("promoted", F.lit(False)).withColumn("spent", F.lit(None).cast("double"))
    return out.unionByName(rest)


def ema(frames: DataFrame, value: str, alpha: float, reset: str | None = None, keep: str | None = None, key: str | list[str] = "clip_id", block: int = scan.BLOCK) -> DataFrame:
    """ema of a value along a clip: starts anew where `reset` holds, passes rows where `keep` is false unchanged.  A clip may be cut into blocks over several tasks."""
    own = frames.withColumn("__r", F.col(reset) if reset else F.lit(False)).withColumn("__k", F.col(keep) if keep else F.lit(True))
    return scan.ema(own, [key] if isinstance(key, str) else key, "frame_idx", value, alpha, "__r", "__k", block).drop("__r", "__k")


def chain_comparison(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per clip: frames whose reference in display order is not the one on the backbone, and the hops since the last
    I frame (or the clip's start) summed over both chains."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = F.last(F.when(on_backbone(), F.col("frame_idx")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = frames.withColumn("shown", F.lag("frame_idx").over(order)).withColumn("ref", ref)
    own = own.withColumn("anchor", F.max(F.when((F.col("ptype") == "I") | F.col("shown").isNull(), F.col("frame_idx"))).over(upto))
    own = own.withColumn("b", F.sum(on_backbone().cast("int")).over(upto))
    hops = F.col("b") - F.first("b").over(Window.partitionBy(key, "anchor").orderBy("frame_idx"))
    own = own.withColumn("hops", hops)
    return own.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("shown").eqNullSafe(F.col("ref"))).alias("differing"), F.sum(F.col("frame_idx") - F.col("anchor")).alias("hops_shown"), F.sum("hops").alias("hops_ref")
    )
