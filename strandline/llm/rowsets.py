"""Rows of a wide table picked by their numbers while the table stays where it is.

The numbers travel as bit sets of 32,768 rows (4 kB each) that are broadcast while there are at
most ``MOST_SETS`` of them, which is half a billion rows.  Beyond that the table meets the
numbers in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

MOST_SETS = 1 << 14  # 64 MB


def split(rows: DataFrame, ids: DataFrame, uid: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows whose number `uid` (from 0) is among ids (one column, repeats are fine), and the other rows."""
    name = ids.columns[0]
    sets = ids.where(F.col(name).isNotNull()).groupBy(F.expr(f"bitmap_bucket_number(`{name}` + 1)").alias("__set")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position(`{name}` + 1))").alias("__bits"))
    sets = staged(sets, "sets")
    if sets.count() > (MOST_SETS if most is None else most):
        ids = ids.select(F.col(name).alias(uid)).distinct()
        return rows.join(ids, uid, "left_semi"), rows.join(ids, uid, "left_anti")
    place = f"bitmap_bit_position(`{uid}` + 1)"
    byte = f"cast(conv(hex(substring(__bits, cast({place} div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = rows.withColumn("__set", F.expr(f"bitmap_bucket_number(`{uid}` + 1)")).join(F.broadcast(sets), "__set", "left")
    marked = marked.withColumn("__in", F.expr(f"coalesce(getbit({byte}, cast({place} % 8 as int)) = 1, false)"))
    return tuple(marked.where("__in" if x else "not __in").select(*[F.col(f"`{c}`") for c in rows.columns]) for x in (True, False))


def picked(rows: DataFrame, ids: DataFrame, uid: str, most: int | None = None) -> DataFrame:
    """The rows whose number `uid` is among ids."""
    return split(rows, ids, uid, most)[0]
