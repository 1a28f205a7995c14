"""Nearest neighbours by multiprobe p-stable hashing.

Index: each of ``TABLES`` tables projects a vector on k random Gaussian directions and cuts each
axis into cells of equal width with a random offset; the k cells are the bucket.  k grows as the
logarithm of the number of vectors.  The scale of the data and the distance r of a tenth
neighbour are fitted on bounded samples (``SAMPLE`` vectors, ``PROBES`` queries against
all rows); every row is indexed.

Search: a neighbour at distance r moves by a normal deviate of scale r on each axis, so each cell
has a chance to hold it.  A query visits buckets of a table in the order of these chances, the
own bucket and perturbed ones, until they sum to the table's share of ``RECALL``.  Tasks
hold the probes of a bucket and stream its vectors past them; the candidates of all tables are
merged and ranked by exact distance in double precision.  The vectors and the probes of large buckets
are both split by a salt and each part of the one meets each part of the other.  A query that finds too few is compared with all rows, in blocks.

Rows with a null vec_id, with a vector that is null, zero, of another length than most, or that
holds null or non-finite components take no part.  Rows of one vec_id count as one candidate, the
nearest.  No vectors or no queries: no rows.  Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

TABLES, NEAREST, RECALL = 2, 10, 0.97
WIDTH = 2.0  # of a cell, in deviations of a projection
SAMPLE, PROBES = 2000, 64
LARGE, MOST_LARGE = 1024, 50_000  # vectors or probes of a bucket that is split; such buckets at most
STEP = 512  # vectors that meet the probes of a bucket at a time
BLOCK = 2000  # queries that meet all rows at a time
FLUSH = 100_000  # queries whose best candidates a task holds
SEED = 7


def usable(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id long, v array<double> of the rows that take part."""
    ok = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok)
    common = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return own.where(F.size("v") == (common[0]["d"] if common else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of q to each row of x, from differences."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 19) // max(1, x.size))
    for k in range(0, len(q), step):
        out[k : k + step] = np.sqrt(((q[k : k + step, None, :] - x[None]) ** 2).sum(2))
    return out


class _Best:
    """The nearest few of each query so far."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, queries: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        for row, q in enumerate(queries.tolist()):
            old = self.held.get(q)
            at = np.flatnonzero((dist[row] <= (old[0][-1] if old and len(old[0]) == self.k else np.inf)) & (ids != q))
            if not len(at):
                continue
            d, i = dist[row][at], ids[at]
            if old:
                d, i = np.concatenate((old[0], d)), np.concatenate((old[1], i))
            order = np.lexsort((i, d))
            d, i = d[order], i[order]
            _, first = np.unique(i, return_index=True)
            first.sort()
            self.held[q] = d[first[: self.k]], i[first[: self.k]]

    def rows(self) -> pa.RecordBatch:
        n = [len(d) for d, _ in self.held.values()]
        cat = lambda k, t: np.concatenate([x[k] for x in self.held.values()]) if n else np.zeros(0, t)
        q = np.repeat(np.fromiter(self.held, np.int64, len(n)), n)
        out = pa.RecordBatch.from_arrays([pa.array(q), pa.array(cat(1, np.int64)), pa.array(cat(0, np.float64))], ["query_id", "vec_id", "score"])
        self.held = {}
        return out


FOUND = "query_id long, vec_id long, score double"


def scanned(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The nearest k of a block of queries among the rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for b in batches:
            if b.num_rows:
                best.add(ids, b.column("id").to_numpy(), distances(q, _matrix(b.column("v"), q.shape[1])))
        yield best.rows()

    return vectors.mapInArrow(run, FOUND)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest candidates of each query."""
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


class Index:
    """Directions, offsets, cell width and the distance that the probes aim at; a few kB."""

    def __init__(self, sample: np.ndarray, n: int, r: float, tables: int = TABLES, recall: float = RECALL, width: float = WIDTH, seed: int = SEED):
        d = sample.shape[1]
        self.tables, self.r = tables, r
        self.k = max(1, round(math.log2(max(n, 2)) / 2) - 1)
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, self.k, d))
        self.width = width * max(float(np.std(np.einsum("tkd,nd->ntk", self.a, sample), axis=0).mean()), 1e-12)
        self.b = rng.random((tables, self.k)) * self.width
        self.share = 1 - (1 - recall) ** (1 / tables)  # what one table must reach

    def places(self, x: np.ndarray) -> np.ndarray:
        """(n, tables, k): places on the axes, in cells."""
        return (np.einsum("tkd,nd->ntk", self.a, x) + self.b) / self.width

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit names of cell vectors (..., k)."""
        out = np.zeros(cells.shape[:-1], np.uint64)
        for j in range(cells.shape[-1]):
            out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Cell vectors of one query in one table, most likely first, until their chances sum to the share."""
        scale = max(self.r / self.width, 1e-9)
        own = np.floor(place)
        reach = int(math.ceil(4 * scale)) + 1
        offs = np.arange(-reach, reach + 1)
        edge = own[:, None] + np.append(offs, reach + 1) - place[:, None]
        cdf = np.vectorize(lambda t: 0.5 * math.erfc(-t / math.sqrt(2)))(edge / scale)
        chance = np.diff(cdf, axis=1)
        order = np.argsort(-chance, axis=1, kind="stable")
        logs = np.log(np.maximum(np.take_along_axis(chance, order, 1), 1e-300))
        k, out, total = len(place), [], 0.0
        heap = [(-logs[:, 0].sum(), (0,) * k, 0)]
        while heap and total < self.share:
            cost, at, axis = heapq.heappop(heap)
            out.append(at)
            total += math.exp(-cost)
            for j in range(axis, k):  # each vector of ranks comes from one other
                if at[j] + 1 < len(offs):
                    heapq.heappush(heap, (cost + logs[j, at[j]] - logs[j, at[j] + 1], (*at[:j], at[j] + 1, *at[j + 1 :]), j))
        ranks = np.array(out)
        return own + offs[order[np.arange(k), ranks]]


ENTRIES = "t int, bucket long, probe boolean, id long, v array<double>"


def _entries(index: Index, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            place = index.places(_matrix(b.column("v"), index.a.shape[2]))
            for t in range(index.tables):
                if probe:
                    cells = [index.probes(p) for p in place[:, t]]
                    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                    keys = index.keys(np.concatenate(cells))
                else:
                    row, keys = np.arange(b.num_rows), index.keys(np.floor(place[:, t]))
                for s in range(0, len(row), 10_000):
                    r = pa.array(row[s : s + 10_000])
                    head = [pa.array(np.full(len(r), t, np.int32)), pa.array(keys[s : s + 10_000]), pa.array(np.full(len(r), probe))]
                    yield pa.RecordBatch.from_arrays([*head, b.column("id").take(r), b.column("v").take(r)], ["t", "bucket", "probe", "id", "v"])

    return run


def _visits(k: int, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, ids, q = _Best(k), None, np.zeros(0, np.int64), np.zeros((0, d))
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "bucket", "salt", "probe", "id")]  # salt: part of the vectors and of the probes
            x = _matrix(b.column("v"), d)
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for lo, hi in zip(np.append(0, new), np.append(new, b.num_rows), strict=True):
                here = tuple(c[lo] for c in cols[:3])
                if here != key:
                    key, ids, q = here, np.zeros(0, np.int64), np.zeros((0, d))
                if cols[3][lo]:
                    ids, q = np.concatenate((ids, cols[4][lo:hi])), np.concatenate((q, x[lo:hi]))
                elif len(ids):
                    for at in range(lo, hi, STEP):
                        best.add(ids, cols[4][at : min(at + STEP, hi)], distances(q, x[at : min(at + STEP, hi)]))
            if len(best.held) > FLUSH:
                yield best.rows()
        yield best.rows()

    return run


def fitted(vectors: DataFrame, n: int, k: int = NEAREST, **options) -> Index:
    """An index fitted on SAMPLE vectors and on the neighbours of PROBES of them among all rows."""
    rows = vectors.withColumn("h", F.xxhash64("id", "v")).orderBy("h", "id").limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in rows])
    ids = np.array([r["id"] for r in rows[:PROBES]])
    near = nearest(scanned(vectors, ids, sample[:PROBES], k), k).groupBy("query_id").agg(F.max("score").alias("r"))
    r = float(np.quantile([x["r"] for x in near.collect()] or [1.0], 0.75))
    return Index(sample, n, r, **options)


def _parts(entries: DataFrame, name: str) -> DataFrame:
    """t, bucket and the number of parts that each large bucket is split into, MOST_LARGE rows at most."""
    large = F.greatest(F.lit(LARGE), F.lit(entries.count() // MOST_LARGE))
    sizes = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > large)
    return sizes.select("t", "bucket", F.ceil(F.col("c") / large).cast("int").alias(name))


def search(rows: DataFrame, is_query: Column, k: int = NEAREST, ident: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row for which is_query (over `id`) holds."""
    spark = rows.sparkSession
    vectors = staged(usable(rows, ident, vector), "vectors")
    queries = vectors.where(is_query)
    n = vectors.select("id").distinct().count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fitted(vectors, n, k, **options)
    d = index.a.shape[2]
    entries = staged(vectors.mapInArrow(_entries(index, False), ENTRIES), "entries")
    probed = staged(queries.mapInArrow(_entries(index, True), ENTRIES), "probes")
    parts = _parts(entries, "parts").join(_parts(probed, "blocks"), ["t", "bucket"], "full")
    parts = F.broadcast(staged(parts.na.fill(1, ["parts", "blocks"]), "parts"))  # 2 * MOST_LARGE rows at most
    own, other = F.expr("cast(pmod(xxhash64(id), own) as int)"), F.explode(F.sequence(F.lit(0), F.col("other") - 1))

    def dealt(rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        """rows with the part of their own kind and a copy for each part of the other kind."""
        known = rows.join(parts, ["t", "bucket"], "left").withColumn("own", F.coalesce(mine, F.lit(1))).withColumn("other", F.coalesce(theirs, F.lit(1)))
        return known.withColumn("mine", own).withColumn("theirs", other)

    salted = dealt(entries, "parts", "blocks").withColumn("salt", F.struct(F.col("mine").alias("i"), F.col("theirs").alias("j")))
    probes = dealt(probed, "blocks", "parts").withColumn("salt", F.struct(F.col("theirs").alias("i"), F.col("mine").alias("j")))
    salted, probes = (x.withColumn("salt", F.expr("shiftleft(cast(salt.i as bigint), 32) + salt.j")) for x in (salted, probes))
    cols = ["t", "bucket", "salt", "probe", "id", "v"]
    met = salted.select(cols).union(probes.select(cols)).repartition("t", "bucket", "salt")
    found = met.sortWithinPartitions("t", "bucket", "salt", F.desc("probe")).mapInArrow(_visits(k, d), FOUND)
    out = staged(nearest(found, k), "nearest")
    counts = out.groupBy("query_id").count()
    few = queries.select("id").distinct().join(counts, F.col("id") == F.col("query_id"), "left").where(F.coalesce("count", F.lit(0)) < min(k, n - 1))
    few = staged(few.select("id", F.coalesce("count", F.lit(0)).alias("had")), "few")
    left = few.count()
    if not left:
        return out
    blocks = -(-left // BLOCK)
    again = None
    for j in range(blocks):
        own = queries.join(few.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == j), "id", "left_semi").dropDuplicates(["id"]).collect()
        if own:
            part = scanned(vectors, np.array([r["id"] for r in own]), np.array([r["v"] for r in own]), k)
            again = part if again is None else again.union(part)
    return out.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(out.columns).union(nearest(again, k))
