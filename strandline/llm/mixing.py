"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...  Together they share
   ``SHARE`` times all words by weight; a target stops at ``MOST`` times its source's words and
   the rest goes to the others by weight.  That is one water level over the sources, found
   with window sums over a table of one row per source.
2. A source is cut into blocks by a hash of its documents, so no task holds a source.  Blocks
   are drawn in a permuted order, whole passes first; where the target ends inside a block,
   the documents of that block go on in a permuted order of their own, and the last one goes
   in if that brings the words nearer to the target.
3. The block draws of all sources are dealt to output shards of equal size: a tree halves the
   shards and draws from a multivariate hypergeometric distribution how many draws of each
   source go left.  Every node of the tree has a seed of its own, so any task can follow it.
   There is a shard for each ``SHARD_WORDS`` words of the mix.
4. In its shard a document's place is a hash of shard, draw and document: a local shuffle.  Rows are
   dealt to tasks by ranges of (shard, place), so a task's rows don't depend on a shard's size.

Nulls: a null text has size 0; a null source is a source of its own.  A null doc_id is like
any other value.  Repeated rows are documents of their own; rows equal in doc_id, source and
size that stand at the end of the mix may be told apart by nothing and then go together.
Empty tables give empty results.  All choices are hashes with a seed: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import local_table, staged
from .textops import SPACED_WORD

#: Fixed values of the mix: weights by rank, share of all words, most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_ROWS, MOST_BLOCKS = 64, 4096  # rows a block where blocks are few, blocks a source where rows are many
SEED = 20240607
SHARD_WORDS, LEAST_SHARDS = 10_000_000, 16  # words of an output shard, about; shards of a small mix
MOST_SOURCES = 100_000
MOST_QUOTAS = 20_000_000  # sources times shards of the splitting tree, 8 bytes each on the driver
BROADCAST_BLOCKS = 200_000  # rows of the draws by block that go to every task; more meet the documents in a shuffle


def word_count(text):
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, n_rows and source_size of each source with its target; source_key: null as the struct's flag.

    sources has one row per source, so the windows without a partition hold few rows.
    """
    by_name = Window.orderBy("source_key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("full_at", "source_key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("full_at"))
    water = F.min(F.when(F.col("open"), F.struct("full_at", "source_key", "level"))).over(every)["level"]
    target = F.when(water.isNull(), F.col("cap")).otherwise(F.least("cap", water * F.col("weight")))
    return levels.select("source_key", "n_rows", "source_size", target.alias("target"))


def shards_for(words: float, sources: int) -> int:
    """Output shards of a mix of so many words: a power of two, doubled while shards hold over SHARD_WORDS and quotas fit."""
    shards = LEAST_SHARDS
    while shards * SHARD_WORDS < words and 2 * shards * max(sources, 1) <= MOST_QUOTAS:
        shards *= 2
    return shards


def quotas(draws: dict[int, int], shards: int, seed: int = SEED) -> dict[int, np.ndarray]:
    """Draws of each source for each shard: {source: counts by shard}; shards differ by one draw at most.

    draws: {source number: block draws}.  The tree has 2 * shards nodes, each with a vector over sources.
    """
    names = sorted(draws)
    total = np.array([draws[s] for s in names], np.int64)
    size = np.full(shards, total.sum() // shards)
    size[: total.sum() % shards] += 1
    out = np.zeros((len(names), shards), np.int64)

    def split(lo: int, hi: int, colours: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = colours
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros(len(colours), np.int64)
        rest, room = int(colours.sum()), int(size[lo:mid].sum())
        for k, c in enumerate(colours):
            rest -= int(c)
            left[k] = rng.hypergeometric(int(c), rest, room) if room and c and rest else min(int(c), room)
            room -= left[k]
        split(lo, mid, left)
        split(mid, hi, colours - left)

    if len(names):
        split(0, shards, total)
    return {s: out[k] for k, s in enumerate(names)}


def _key(source):
    return F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"))


def mixture(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """row, a struct of the columns of docs (doc_id, text, source), and for each row size, source_size, target,
    draws: array of (pass, shard, place) for each time that the mix takes the document.  shards: None for as many as shards_for says."""
    spark = docs.sparkSession
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), word_count(F.col("text")))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])  # so that no name of docs meets one of these
    sized = docs.select(row.alias("row"), word_count(F.col("text")).alias("size"), _key(F.col("source").cast("string")).alias("key"), spread.alias("h"))
    narrow = sized.select(F.col("key").alias("source_key"), F.col("size").alias("size"), F.col("h").alias("h"))
    sources = targets(narrow.groupBy("source_key").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size")), weights, share, most)
    blocks = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_rows") / BLOCK_ROWS))).cast("int")
    sources = staged(sources.withColumn("number", F.row_number().over(Window.orderBy("source_key")) - 1).withColumn("blocks", blocks), "sources")
    n = sources.count()
    if n > MOST_SOURCES:
        raise ValueError(f"{n} sources; the splitting tree is made for at most {MOST_SOURCES}")
    few = F.broadcast(sources)  # at most MOST_SOURCES rows, checked above
    block = F.pmod("h", F.col("blocks")).cast("int")
    by_block = narrow.join(few, "source_key").groupBy("source_key", block.alias("block")).agg(F.sum("size").alias("words"))
    # blocks of a source in permuted order; at most MOST_BLOCKS rows a source
    order = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed), "block"), "block")
    lined = by_block.join(few, "source_key").withColumn("turn", F.row_number().over(order) - 1)
    lined = lined.withColumn("ahead", F.sum("words").over(order) - F.col("words")).withColumn("used", F.count("block").over(Window.partitionBy("source_key")))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    lined = lined.withColumn("passes", passes).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    # words of this block in the pass that is not whole: all, none or the first `room` of them
    lined = staged(lined.withColumn("room", F.greatest(F.lit(0.0), F.col("left") - F.col("ahead"))).select("source_key", "number", "block", "words", "turn", "used", "passes", "room", "source_size", "target"), "blocks")
    lines = lined.count()
    part = lined.where("room > 0 and room < words")  # one block a source at most
    drawn = lined.groupBy("number").agg(F.sum(F.col("passes") + (F.col("room") > 0).cast("int")).cast("long").alias("draws")).collect()  # a row a source
    if shards is None:
        shards = shards_for(sources.agg(F.sum("target")).first()[0] or 0.0, n)
    dealt = quotas({r["number"]: r["draws"] for r in drawn}, shards, seed)
    ends = local_table(spark, {"number": pa.array(list(dealt), pa.int32()), "ends": pa.array([np.cumsum(q) for q in dealt.values()], pa.list_(pa.int64()))})
    # draw p * used + turn of a source belongs to the shard whose quota it falls into
    shard = lambda p: F.expr(f"size(filter(ends, e -> e <= {p} * used + turn))")
    lined = lined.join(F.broadcast(ends), "number")  # as many rows as sources
    lined = lined.withColumn("whole", F.expr("transform(if(passes > 0, sequence(0, passes - 1), array()), p -> struct(cast(p as int) as pass, size(filter(ends, e -> e <= p * used + turn)) as shard))"))
    lined = lined.withColumn("rest", F.when(F.col("room") > 0, F.struct(F.col("passes").alias("pass"), shard("passes").alias("shard"))))
    # in a block that the target ends in, documents go in by their hash while they fit
    within = Window.partitionBy("source_key", "block").orderBy("h")
    inner = narrow.join(few.select("source_key", "blocks"), "source_key").withColumn("block", block)
    inner = inner.join(F.broadcast(part.select("source_key", "block", "room")), ["source_key", "block"])  # a row a source
    inner = inner.groupBy("source_key", "block", "room", "h").agg(F.sum("size").alias("size"))
    inner = inner.withColumn("upto", F.sum("size").over(within)).where("upto - size / 2.0D <= room")
    last = inner.groupBy("source_key", "block").agg(F.max("h").alias("upto_h"))
    lined = lined.join(last, ["source_key", "block"], "left")
    lined = lined.withColumn("until", F.expr("case when rest is null then null when room >= words then 9223372036854775807 else upto_h end"))
    out = sized.join(few.select(F.col("source_key").alias("key"), F.col("blocks").alias("blocks")), "key").withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    plan = lined.select(F.col("source_key").alias("key"), F.col("block").alias("block"), F.col("source_size").alias("source_size"), F.col("target").alias("target"), F.col("whole").alias("whole"), F.col("rest").alias("rest"), F.col("until").alias("until"))
    if lines <= BROADCAST_BLOCKS:
        plan = F.broadcast(plan)  # so texts are shuffled only on their way to the output shards
    out = out.join(plan, ["key", "block"])
    taken = F.expr("if(until is not null and h <= until, array_append(whole, rest), whole)")
    draws = F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["shard"], d["pass"], F.col("h")).alias("place")))
    return out.withColumn("draws", draws).select("row", "size", "source_size", "target", "draws")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of docs; shards: where its copies go."""
    out = mixture(docs.select("doc_id", "text", "source"), **options)
    taken = (F.col("size") * F.size("draws")).alias("taken")
    return out.select("row.doc_id", "size", "source_size", "target", taken, F.col("draws.shard").alias("shards"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: a row of docs for each time that it is taken, with mix_pass and mix_shard (which replace columns of that name), each shard in its shuffled order."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("mix_pass", "mix_shard")]
    rows = mixture(docs, **options).select("row", F.explode("draws").alias("draw"))
    rows = rows.repartitionByRange("draw.shard", "draw.place").sortWithinPartitions("draw.shard", "draw.place")
    return rows.select(*own, F.col("draw.pass").alias("mix_pass"), F.col("draw.shard").alias("mix_shard"))
