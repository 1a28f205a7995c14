"""Exact medians of large groups in two passes, so that no task holds a group.

Values are counted by level, a count that is formed before the shuffle; the levels that hold the middle
ranks are told by running counts, and only values in these are looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def medians(rows: DataFrame, by: list[str], value: Column, name: str, width: float = 1.0) -> DataFrame:
    """by, `name` (the median of the values that are not null, the mean of the middle two of an even number) and n.

    width: of a level; groups whose values lie in few levels have more to sort in the second pass.  NaN counts as the largest value."""
    own = rows.select(*by, value.cast("double").alias("v")).where("v is not null").withColumn("level", F.floor(F.col("v") / width))
    own = own.withColumn("level", F.when(F.isnan("v"), F.lit(2**62)).otherwise(F.col("level")))
    counts = own.groupBy(*by, "level").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    told = told.withColumn("lo", F.floor((F.col("n") + 1) / 2)).withColumn("hi", F.floor(F.col("n") / 2) + 1).withColumn("before", F.col("upto") - F.col("c"))
    middle = told.where("(before < lo and lo <= upto) or (before < hi and hi <= upto)").select(*by, "level", "n", "lo", "hi", "before")  # two rows a group at most
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"m.{c}")) for c in (*by, "level")]
    near = own.alias("o").join(middle.alias("m"), same).select(*[F.col(f"o.{c}").alias(c) for c in by], "o.level", "v", "n", "lo", "hi", "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*by, "level").orderBy("v"))
    chosen = near.withColumn("rank", rank).where("rank = lo or rank = hi")
    return chosen.groupBy(*by).agg(F.avg("v").alias(name), F.first("n").alias("n"))
