"""Ranked lexical search with MaxScore in each shard of documents.

1. The items' distinct terms are the query terms.  Items are taken in blocks of about ``MOST_TERMS`` terms,
   so what travels to the tasks is bounded however many items there are; as a rule there is one block.
2. One pass over the texts writes shards: a row of posting lists (document, occurrences) of the query
   terms, with the lengths of its documents, in order of doc_id.  A shard ends at ``SHARD_HITS`` occurrences or
   ``SHARD_DOCS`` documents, so its size doesn't depend on the table's.
3. Counts of documents, terms and documents of each term are summed over the shards.
4. In every shard, for each item: the lists are ordered by their upper bounds, the largest score that
   any posting gives.  Lists whose bounds sum to no more than the score of the last of the k best so far
   are non-essential: no document of these alone can enter.  Windows of documents are scored by the essential
   lists; the others are probed, largest bound first, for the documents that can still enter.
5. The k best of all shards are merged by a window, which Spark limits before the shuffle.

A term is a run of letters, digits and non-ASCII characters, A-Z in lower case.  Sums are 64-bit integers.

Nulls: a null text has no terms and counts nowhere; a null item finds nothing; a null doc_id comes last
among equal scores.  Repeated documents each count and are listed; each row of items is an item of
its own, also under a repeated or null item_id.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import local_table, staged
from .textops import ALNUM_FOLD, text_bytes

BEST = 50
MOST_TERMS = 500_000  # of a block of items
SHARD_HITS, SHARD_DOCS = 1 << 20, 1 << 16
WINDOW_DOCS = 2048


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_FOLD).split()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = [sorted(set(terms_of(t.as_py()))) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("number"), pa.array(terms, pa.list_(pa.binary()))], ["number", "terms"])


SHARD = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, sizes array<int>, docs array<int>, tf array<int>"


def _shards(known: dict[bytes, int], most_hits: int, most_docs: int):
    """Posting lists of the known terms, a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = held = 0
        ids, lengths, hits = [], [], []

        def row() -> pa.RecordBatch:
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            doc = np.repeat(np.arange(len(order)), [len(hits[k]) for k in order])
            term = np.concatenate([np.zeros(0, np.int64), *(hits[k] for k in order)])
            both, tf = np.unique(term * max(len(order), 1) + doc, return_counts=True)
            term, doc = both // max(len(order), 1), both % max(len(order), 1)
            terms, sizes = np.unique(term, return_counts=True)
            lists = [([ids[k] for k in order], pa.int64()), ([lengths[k] for k in order], pa.int64()), *((x.astype(np.int32), pa.int32()) for x in (terms, sizes, doc, tf))]
            return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in lists)], [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                terms = terms_of(text.as_py())
                n_docs, n_terms = n_docs + bool(terms), n_terms + len(terms)
                own = [known[t] for t in terms if t in known]
                if own:
                    ids.append(doc_id)
                    lengths.append(len(terms))
                    hits.append(np.array(own, np.int64))
                    held += len(own)
                if held >= most_hits or len(ids) >= most_docs:
                    yield row()
                    n_docs = n_terms = held = 0
                    ids, lengths, hits = [], [], []
        if n_docs:
            yield row()

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part_of(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count gives in a document of that length, without the term's weight."""
    some, at = np.unique(lengths, return_inverse=True)
    m = np.array([50 + 50 * n * n_docs // n_terms for n in some.tolist()], np.int64)[at]
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, window: int = WINDOW_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of highest score above 0, the smaller number first among equals, and their scores.

    lists: of each term the numbers of its documents in order and what it adds to their scores."""
    lists = sorted(lists, key=lambda x: int(x[1].max()))
    below = np.cumsum([int(x[1].max()) for x in lists])  # what the first lists can add together
    edges = np.arange(0, n_docs + window, window)
    cuts = [np.searchsorted(docs, edges) for docs, _ in lists]
    best_docs = best = np.zeros(0, np.int64)
    least, essential = 0, int(np.searchsorted(below, 0, "right"))  # a document needs more than `least`
    for w, lo in enumerate(edges[:-1].tolist()):
        if essential == len(lists):
            break
        score = np.zeros(window, np.int64)
        for (docs, adds), cut in zip(lists[essential:], cuts[essential:], strict=True):
            s = slice(cut[w], cut[w + 1])
            score[docs[s] - lo] += adds[s]
        doc = np.flatnonzero(score)
        score = score[doc]
        doc += lo
        for j in range(essential - 1, -1, -1):
            can = score + below[j] > least
            doc, score = doc[can], score[can]
            if not len(doc):
                break
            docs, adds = lists[j]
            at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
            score += np.where(docs[at] == doc, adds[at], 0)
        enter = score > least
        if enter.any():
            doc, score = np.concatenate((best_docs, doc[enter])), np.concatenate((best, score[enter]))
            order = np.argsort(-score, kind="stable")[:k]  # earlier documents stand first
            best_docs, best = doc[order], score[order]
            if len(best) == k:
                least = int(best[-1])
                essential = int(np.searchsorted(below, least, "right"))
    return best_docs, best


def _searched(items: list[tuple[int, list[int]]], weights: dict[int, int], n_docs: int, n_terms: int, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                values = {c: b.column(c)[r].values for c in ("ids", "lengths", "terms", "sizes", "docs", "tf")}
                ids = values.pop("ids")
                if not len(ids):
                    continue
                lengths, terms, sizes, docs, tf = (x.to_numpy().astype(np.int64) for x in values.values())
                ends = np.cumsum(sizes)
                adds = part_of(tf, lengths[docs], n_docs, n_terms) * np.repeat(np.array([weights[t] for t in terms.tolist()], np.int64), sizes)
                place = {t: slice(lo, hi) for t, lo, hi in zip(terms.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)}
                for number, own in items:
                    lists = [(docs[s], adds[s]) for t in own if (s := place.get(t)) is not None]
                    if lists:
                        doc, score = max_score(lists, len(ids), k, window)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), number)), ids.take(pa.array(doc)), pa.array(score)], ["number", "doc_id", "score"])

    return run


def _block(docs: DataFrame, queries: DataFrame, k: int, shard_hits: int, shard_docs: int, window: int) -> DataFrame:
    items = [(r["number"], [bytes(t) for t in r["terms"]]) for r in queries.collect()]  # a block: about MOST_TERMS terms
    known = {t: j for j, t in enumerate(sorted({t for _, own in items for t in own}))}
    shards = staged(docs.mapInArrow(_shards(known, shard_hits, shard_docs), SHARD), "shards", **{"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
    weights = {t: weight(n_docs, c) for t, c in df.collect()}  # a row a term of the block
    own = [(number, [known[t] for t in terms]) for number, terms in items]
    return shards.mapInArrow(_searched(own, weights, n_docs or 0, n_terms or 0, k, window), "number long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, most_terms: int = MOST_TERMS, shard_hits: int = SHARD_HITS, shard_docs: int = SHARD_DOCS, window: int = WINDOW_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) the k rows of docs (doc_id, text) with the highest scores above 0."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    numbered = staged(items.select(F.monotonically_increasing_id().alias("number"), "item_id", text_bytes(F.col("text")).alias("text")), "items")
    queries = staged(numbered.mapInArrow(_items, "number long, terms array<binary>"), "terms")
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / most_terms))
    found = None
    for j in range(blocks):
        own = _block(texts, queries.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == j), k, shard_hits, shard_docs, window)
        found = own if found is None else found.union(own)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
