"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, looked_up
from .staging import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """For links (a long, b long): (node long, label long, was long), the least node that each node reaches.

    Each round takes the least label of the neighbours (a sum that is formed before the
    shuffle) and then the label of that label, which halves the paths.  Labels of nodes with very
    many links are broadcast; where very many nodes ask for one label the join's skewed
    partitions are split.  Rounds end when nothing changes.  No links: no rows.
    """
    spark = links.sparkSession
    both = staged(
        links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "links",
    )
    hubs = hot_keys(both, "b")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = (
            looked_up(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        least = labels.select("node", "label").join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        root = labels.select(F.col("node").alias("next"), F.col("label").alias("root"))
        after = staged(
            least.join(root, "next", "left").select("node", F.least("next", "root").alias("label"), F.col("label").alias("was")), "labels"
        )
        moved = after.where("label <> was").limit(1).count()
        dropped(spark, labels)
        labels = after
        if not moved:
            dropped(spark, both, hubs)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components(links so far and `links`): only links between different labels are followed."""
    if not links.limit(1).count():
        return labels
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    named = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(named)
    new = top.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.select("node", "label").join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    alone = top.select("node", "label").join(labels, "node", "left_anti")
    return staged(old.unionByName(alone), "labels")
