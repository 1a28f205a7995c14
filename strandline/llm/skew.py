"""Joins by keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged

MOST_HOT = 10_000


def with_counts(rows: DataFrame, key: str, count: str, *more: Column, most_hot: int = MOST_HOT) -> DataFrame:
    """rows whose key occurs more than once, with that number as column `count` and further aggregates.

    Keys with over 1/most_hot of all rows, so fewer than most_hot of them, are broadcast and their
    rows stay where they are; the others meet their counts in a shuffle.  A null key joins nothing.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count), *more).where(F.col(count) > 1)
    hot = counts.where(F.col(count) > rows.count() / most_hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).union(rest.join(counts, key))


def hot_keys(rows: DataFrame, key: str | list[str], most_hot: int = MOST_HOT) -> DataFrame:
    """The keys with over 1/most_hot of all rows, fewer than most_hot of them."""
    key = [key] if isinstance(key, str) else key
    return staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rows.count() / most_hot).select(*key), "hot")


def looked_up(rows: DataFrame, side: DataFrame, key: str | list[str], hot: DataFrame | None = None) -> DataFrame:
    """rows (each read twice) left joined with side, which has a row for each key at most.

    The side's rows of hot_keys are broadcast and rows with these keys stay where they are; the
    others meet their side in a shuffle.
    """
    key = [key] if isinstance(key, str) else key
    hot = F.broadcast(hot_keys(rows, key) if hot is None else hot)
    mine = rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, "left")
    return mine.unionByName(rows.join(hot, key, "left_anti").join(side, key, "left"))
