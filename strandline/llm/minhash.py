"""Near-duplicate documents from bottom-k sketches of one hash function.

The job runs in these steps, each a Spark stage over narrow rows:

1. ``sketches``: every document's set of 5-word shingles is hashed with one function; the k
   least hashes are its sketch, the sum and the xor of all of them name the set.
2. Documents with equal sets form a class; one representative goes on, so copies cost nothing.
3. Inverted lists of the retained values.  Two sets as alike as 0.75 share at least ``share``
   of their sketches but with a chance under 1e-9, so a class needs entries only for its
   rarest ``1 - share`` retained values (prefix filter); values of one class are left out.
4. Short lists give their pairs, long lists the pairs of each member with the first one.
5. The union of two sketches estimates the likeness; pairs far below the limit are dropped.
   The rest is confirmed on the full sets of both texts, and confirmed links are joined up.
6. A long list whose members have all met in one component is done.  The members of the others
   get inverted lists anew, of the rarest quarter of their full sets: two sets as alike as 0.75
   share a value there, without a chance of error, while a notice that many documents hold is
   outside it unless it is three quarters of them.  Steps 4 and 5 run again over these lists.
7. What is left are documents that mostly consist of what a dozen other, unlike ones hold.  They are dealt
   by size, as sets of unlike sizes are unlike, and in blocks of bounded size; each pair of
   blocks is a task that compares all full sets in numpy and gives a forest of links.

Nulls: a null text is an empty text; empty texts have no shingles and no links.  A null
doc_id takes part like any other and never is a component's name unless all of its ids are null.
Repeated rows are documents of their own with equal sets.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .rowsets import picked
from .skew import looked_up, with_counts
from .staging import numbered, scratch, staged, texts_of
from .textops import chunks, grams, mix, powers, text_bytes, words_of

SHINGLE, PERCENT, SKETCH = 5, 75, 64
SHARE = 0.42  # of a sketch; 27 of 64, over six deviations under the expected 48
ESTIMATE = 0.48  # five deviations under 0.75 for 64 values
SHORT = 12  # members of a list that gives all its pairs
FEW = 2000  # documents in long lists that meet block by block at once, which gives the same links
BLOCK_SHINGLES, BLOCK_DOCS = 200_000, 800  # of a block of members, about


def _sets(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and distinct shingle hashes, ordered by both."""
    w = words_of(offsets, data)
    if not len(w.doc):
        return w.doc, np.zeros(0, np.int64)
    whole = grams(w.hash, size)
    same = w.doc[: len(whole)] == w.doc[size - 1 : size - 1 + len(whole)]
    count = np.bincount(w.doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < size))
    small = np.zeros(len(few), np.uint64)
    for k, d in enumerate(few):
        own = w.hash[first[d] : first[d] + count[d]]
        small[k] = (own * powers(size + 1)[1 : len(own) + 1]).sum(dtype=np.uint64) + np.uint64(len(own))
    doc = np.concatenate((w.doc[: len(whole)][same], few))
    value = np.concatenate((whole[same], mix(small))).view(np.int64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))
    return doc[new], value[new]


def _sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, offsets, data in chunks(b.column("text")):
                doc, value = _sets(offsets, data, size)
                n = np.bincount(doc, minlength=hi - lo)
                first = np.cumsum(n) - n
                place = np.arange(len(doc)) - first[doc]
                kept = value[place < k]
                ends = np.concatenate(([0], np.cumsum(np.minimum(n, k)))).astype(np.int32)
                sums, xors = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(doc):
                    some, spread = np.flatnonzero(n), mix(value.view(np.uint64))
                    sums[some] = np.add.reduceat(spread, first[some])
                    xors[some] = np.bitwise_xor.reduceat(value.view(np.uint64), first[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("uid").slice(lo, hi - lo),
                        b.column("doc_id").slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums.view(np.int64)),
                        pa.array(xors.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)),
                    ],
                    ["uid", "doc_id", "n", "d1", "d2", "sketch"],
                )

    return run


def sketches(texts: DataFrame, size: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """uid, doc_id, n (size of the set), d1 and d2 (its name), sketch (its k least hashes) of texts (uid, doc_id, text)."""
    own = texts.select("uid", F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    return own.mapInArrow(_sketch(size, k), "uid long, doc_id long, n long, d1 long, d2 long, sketch array<long>")


def _near_in_size(percent: int):
    return F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")


def estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches of the union hold at least the share `least` of common values."""
    side = lambda x: reps.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_in_size(percent))
    return (
        both.withColumn("u", F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k))
        .where(F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b"))) >= least * F.size("u"))
        .select("a", "b")
    )


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for b in batches:
            a_ids, b_ids, keep = b.column("a").to_numpy(), b.column("b").to_numpy(), []
            left, right = b.column("text_a"), b.column("text_b")
            for k in range(len(a_ids)):
                if held != a_ids[k]:
                    held, own = a_ids[k], _one(left[k].as_py(), size)
                other = _one(right[k].as_py(), size)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common) > 0)
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a_ids[keep]), pa.array(b_ids[keep])], ["a", "b"])

    return run


def _one(text: bytes, size: int) -> np.ndarray:
    return _sets(np.array([0, len(text)], np.int64), np.frombuffer(text, np.uint8), size)[1]


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are alike enough; texts: cid, text."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a long, b long")


def _keys(entries: DataFrame, least: str) -> DataFrame:
    """(v, cid, n): entries of the inverted lists, for each class the rarest values of its set that can't all be
    missed by a set like it.

    entries: cid, n, held (values of the class) and v, a row a value; least: how many of `held` values such a set shares."""
    common = with_counts(entries, "v", "df").groupBy("cid", "n", "held").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    room = F.expr(f"held - cast({least} as int) + 1 - (held - size(vs))")
    return (
        common.withColumn("room", room)
        .where("room > 0")
        .select("cid", "n", F.explode(F.slice("vs", F.lit(1), F.col("room"))).alias("e"))
        .select(F.col("e.v").alias("v"), "cid", "n")
    )


def _values(size: int):
    """A row for each value of the full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column("cid").to_numpy()
            for lo, hi, offsets, data in chunks(b.column("text")):
                doc, value = _sets(offsets, data, size)
                n = np.bincount(doc, minlength=hi - lo).astype(np.int32)
                for s in range(0, len(doc), 100_000):
                    d = doc[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(cid[lo:hi][d]), pa.array(n[d]), pa.array(value[s : s + 100_000])], ["cid", "held", "v"])

    return run


def _block_links(size: int, percent: int):
    """Links within a group of two blocks, from all pairs of full sets; a forest of them is enough."""

    def linked(group: list, within: bool) -> list[tuple[int, int]]:
        cid, label, mine = (np.array([g[k] for g in group]) for k in range(3))
        sets = [_one(g[3], size) for g in group]
        n = np.array([len(x) for x in sets])
        doc, value = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        _, value, times = np.unique(value, return_inverse=True, return_counts=True)
        doc, value = doc[times[value] > 1], value[times[value] > 1]
        _, value = np.unique(value, return_inverse=True)
        order = np.argsort(value, kind="stable")
        doc, value = doc[order], value[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(value.max(initial=-1)) + 1, 2048):  # exact: counts stay far below 2**24
            s = slice(*np.searchsorted(value, (lo, lo + 2048)))
            held = np.zeros((len(sets), 2048), np.float32)
            held[doc[s], value[s] - lo] = 1
            common += held @ held.T
        near = 100 * common >= percent * (n[:, None] + n[None] - common)
        np.fill_diagonal(near, False)
        if not within:
            near &= mine[:, None] != mine[None]
        out = []
        for x in range(len(sets)):
            others = np.flatnonzero(near[x] & (label != label[x]))
            for lab, y in dict(zip(label[others].tolist(), others.tolist(), strict=True)).items():
                out.append((int(min(cid[x], cid[y])), int(max(cid[x], cid[y]))))
                label[label == lab] = label[x]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            out = linked(group, key[1] == key[2])
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        key, group = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("g", "i", "j", "cid", "label", "mine")]
            texts = b.column("text")
            for r, (g, i, j, *rest) in enumerate(zip(*cols, strict=True)):
                if key != (g, i, j):
                    if group:
                        yield close()
                    key, group = (g, i, j), []
                group.append((*rest, texts[r].as_py()))
        if group:
            yield close()

    return run


def _block_pairs(rest: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among members of long lists that hold several components.

    Lists that share members are one group, which is dealt by the size of its sets: a band of sizes
    meets itself and the next one.  A band is cut into blocks of bounded size by a hash; each pair
    of blocks is a task of its own that compares full sets, so nothing is estimated.
    """
    groups = components(rest.where("cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct())
    band = F.floor(F.log("n") / np.log(100 / percent)).cast("int")
    members = rest.select("cid", "n", "label").distinct().join(groups.select(F.col("node").alias("cid"), F.col("label").alias("g")), "cid")
    members = staged(members.withColumn("band", F.explode(F.array(band, band - 1))), "members")
    sizes = members.groupBy("g", "band").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("k"))
    mine = F.expr("cast(pmod(xxhash64(cid), k) as int)")
    spread = looked_up(members, sizes, ["g", "band"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    key = F.xxhash64("g", "band").alias("g")
    dealt = spread.select(key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "label").join(texts, "cid")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_block_links(size, percent), "a long, b long")


def _met(keys: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to look at: all of short lists, each member with the first one in long lists; and the entries of long lists."""
    listed = staged(with_counts(keys, "v", "c", F.min("cid").alias("pivot")), "listed")
    short = listed.where(f"c <= {SHORT}").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("cid", "n"))).alias("m"))
    pairs = (
        short.select(F.posexplode("m").alias("i", "x"), "m")
        .select(F.col("x.cid").alias("a"), F.col("x.n").alias("n_a"), F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
        .select("a", F.col("y.cid").alias("b"), "n_a", F.col("y.n").alias("n_b"))
        .where(_near_in_size(percent))
        .select("a", "b")
    )
    long = listed.where(f"c > {SHORT}")
    first = long.where("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
    return pairs.union(first).distinct(), long


def _apart(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of long lists whose members are in several components, with their labels."""
    active = long.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    active = staged(active.select("v", "cid", "n", "pivot", "label"), "active")
    split = active.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v", F.lit(True).alias("apart"))
    return staged(looked_up(active, split, "v").where("apart").drop("apart"), "rest")


def links(reps: DataFrame, texts: DataFrame, size: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH, share: float = SHARE) -> DataFrame:
    """Components over classes: (node, label) for each class with a link to another.

    reps: cid, n, sketch of each class; texts: cid and text of its representative, and of others.
    """
    entries = reps.select("cid", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("v"))
    pairs, long = _met(staged(_keys(entries, f"floor({share} * held)"), "lists"), percent)
    likely = staged(estimated(pairs, reps, percent, k, ESTIMATE), "likely")
    found = staged(confirmed(likely, picked(texts, likely.select(F.explode(F.array("a", "b")).alias("id")), "cid"), size, percent), "found")
    labels = components(found)
    rest = _apart(long, labels)
    if not rest.limit(1).count():
        return labels
    own = staged(picked(texts, rest.select("cid"), "cid"), "texts")
    if own.count() <= FEW:
        return joined(labels, staged(_block_pairs(rest, own, size, percent), "found"))
    values = staged(own.mapInArrow(_values(size), "cid long, held int, v long"), "values")
    pairs, long = _met(staged(_keys(values.withColumn("n", F.col("held").cast("long")), f"ceil({percent} * cast(held as long) / 100)"), "lists"), percent)
    more = staged(confirmed(pairs, own, size, percent), "found")
    labels = joined(labels, more)
    rest = _apart(long, labels)
    if not rest.limit(1).count():
        return labels
    return joined(labels, staged(_block_pairs(rest, picked(own, rest.select("cid"), "cid"), size, percent), "found"))


def _labelled(rows: DataFrame, size: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH, share: float = SHARE) -> DataFrame:
    """near_duplicates of numbered rows, with label, the row number that stands for the component; null without shingles."""
    docs = texts_of(rows)
    own = staged(sketches(docs, size, k), "sketches")
    some = own.where("n > 0")
    reps = staged(some.groupBy("d1", "d2", "n").agg(F.min("uid").alias("cid"), F.min_by("sketch", "uid").alias("sketch"), F.min("doc_id").alias("least")), "classes")
    texts = docs.select(F.col("uid").alias("cid"), text_bytes(F.col("text")).alias("text"))
    with scratch(docs.sparkSession) as kept:
        labels = links(reps.select("cid", "n", "sketch"), texts, size, percent, k, share)
        kept.append(labels)
    named = staged(reps.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid")).drop("sketch"), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = looked_up(named.select("d1", "d2", "n", "label"), least, "label")
    return (
        looked_up(own.select("uid", "doc_id", "n", "d1", "d2"), classes, ["d1", "d2", "n"])
        .select(
            "uid",
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            "label",
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """uid, doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    return _labelled(numbered(docs), **options).drop("label")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those that repeat an earlier document; of each component the row with least (doc_id, uid) stays, null ids last.

    Rows without shingles have no links: of those with one doc_id one stays, and all with a null one."""
    every = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        rows = _labelled(every, **options).where("kept")
        alone = F.col("label").isNull()
        by = [F.coalesce("label", F.when(F.col("doc_id").isNull(), F.col("uid"))).alias("label"), F.when(alone, F.col("doc_id")).alias("own")]
        # kept rows of a component all have its least id
        found = staged(rows.groupBy(*by).agg(F.min("uid").alias("uid")), "kept")
        kept.append(found)
    return picked(every, found.select("uid"), "uid").select("row.*")
