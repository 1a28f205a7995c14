"""Disjoint spans out of overlapping ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, by: list[str], *more: str) -> DataFrame:
    """by, lo, hi and `more` (of the first part): the union of the spans [lo, hi) of each group as disjoint ones; spans that touch become one.

    One pass over the sorted spans of a group, linear in their number."""
    order = Window.partitionBy(*by).orderBy("lo", "hi", *more)
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("__new", F.coalesce(before < F.col("lo"), F.lit(True)).cast("long"))
    part = new.withColumn("__part", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = [F.min_by(c, F.struct("lo", "hi", *more)).alias(c) for c in more]
    return part.groupBy(*by, "__part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *first).drop("__part")
