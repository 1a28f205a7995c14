"""Passages that repeat across documents, from a sparse suffix array.

Suffixes are kept only at content-selected places: a place is kept if the hash of its
``key`` words is least in some run of ``least - key + 1`` places.  Every passage of ``least``
words therefore holds a kept place, the same one in each of its copies, with ``key``
words after it.  The steps:

1. Every text gives (hash of the key words, document, place) for its kept places; hashes
   that occur once go, by a count that is formed before the shuffle; very frequent ones are
   told by a broadcast of bounded size, so their places stay spread.
2. The remaining suffixes fetch their contexts: up to ``least - key`` words to the left and as
   many beyond the key, as 32-bit word hashes.  They end where a lesser hash comes, so that a
   window is seen only from the kept place that is least in it, the same one in all copies.
3. They are sorted by key, right context, left context, document and place (a range
   partitioning, so a passage that stands in a third of all documents spreads over tasks).
4. A stream over each partition hashes the windows of ``least`` words that hold the key of
   each suffix and looks for equal ones.  Of a key whose suffixes lie in several slabs or
   partitions, each piece sends every window that has no earlier copy in it on by its hash,
   once, with its last copy; the first and the last copy of all decide there.
5. A window repeats (``again``) if an earlier copy exists, by row number, then place; it is
   first if only later ones do.  The windows of a document are merged, which covers passages
   of any length.

Copies are windows with equal 64-bit hashes, over the 64-bit hash of the key and the 32-bit hashes of the words around
it; neighbours in suffix order bound how far windows are looked at.  The words themselves are not compared again.

Words are separated by ASCII white space and compared with A-Z in lower case.

Nulls and texts under ``least`` words have no passages.  Repeated rows repeat each other.
Windows of a document are copies of each other when they don't overlap.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rowsets import split
from .skew import with_counts
from .spans import merged
from .staging import dropped, numbered, staged, texts_of
from .textops import chunks, grams, mix, powers, text_bytes, words_of

LEAST, KEY = 50, 25
SLAB = 20_000  # suffixes that a task holds at a time


def _slide(fn, v: np.ndarray, w: int) -> np.ndarray:
    """fn over each run of w values."""
    m, size = v, 1
    while size * 2 <= w:
        m, size = fn(m[:-size], m[size:]), size * 2
    return fn(m[: len(v) - w + 1], m[w - size :]) if size < w else m


def _selected(g: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is least in some run of w places; g: hash of the key words of each place."""
    top = np.uint64(2**64 - 1)
    v = np.where(valid, g, top)
    if len(v) < w:
        return np.zeros(0, np.int64)
    least = _slide(np.minimum, v, w)
    edge = np.zeros(w - 1, np.uint64)
    return np.flatnonzero((_slide(np.maximum, np.concatenate((edge, least, edge)), w) == v) & valid)


def _reach(g: np.ndarray, valid: np.ndarray, at: np.ndarray, width: int, step: int) -> np.ndarray:
    """Places in a row beside each of `at`, width at most, whose hashes are not less than its own."""
    out, alive = np.zeros(len(at), np.int16), np.ones(len(at), bool)
    for d in range(1, width + 1):
        x = at + step * d
        y = np.clip(x, 0, len(g) - 1)
        alive &= (x == y) & valid[y] & (g[y] >= g[at])
        out += alive
    return out


def _places(least: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = b.column("uid").to_numpy()
            for lo, hi, offsets, data in chunks(b.column("text")):
                w = words_of(offsets, data)
                count = np.bincount(w.doc, minlength=hi - lo)
                g = grams(w.hash, key)
                valid = (w.doc[: len(g)] == w.doc[key - 1 : key - 1 + len(g)]) & (count[w.doc[: len(g)]] >= least)
                at = _selected(g, valid, least - key + 1)
                doc = w.doc[at]
                place = at - (np.cumsum(count) - count)[doc]
                reach = _reach(g, valid, at, least - key, -1) * np.int16(128) + _reach(g, valid, at, least - key, 1)
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(uid[lo:hi][doc]), pa.array(place.astype(np.int32)), pa.array(reach)], ["key", "uid", "place", "reach"])

    return run


def _contexts(least: int, key: int):
    width = least - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, keys, places, reaches = (b.column(c) for c in ("uid", "keys", "places", "reaches"))
            for lo, hi, offsets, data in chunks(b.column("text")):
                w = words_of(offsets, data)
                short = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                count = np.bincount(w.doc, minlength=hi - lo)
                first = np.cumsum(count) - count
                each = np.diff(places.offsets.to_numpy()[lo : hi + 1])
                doc = np.repeat(np.arange(hi - lo), each)
                place = places.slice(lo, hi - lo).flatten().to_numpy().astype(np.int64)
                at, reach = first[doc] + place, reaches.slice(lo, hi - lo).flatten().to_numpy()
                for s in range(0, len(at), SLAB):
                    a, d, near = at[s : s + SLAB, None], doc[s : s + SLAB], reach[s : s + SLAB, None]
                    right, left, k = a + key + np.arange(width), a - 1 - np.arange(width), np.arange(width)
                    r = np.where(k < near % 128, short[np.minimum(right, len(short) - 1)], 0).astype(">u4")
                    ll = np.where(k < near // 128, short[np.maximum(left, 0)], 0).astype(">u4")
                    fixed = pa.binary(4 * width)
                    cut = lambda x: pa.FixedSizeBinaryArray.from_buffers(fixed, len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(lo, hi - lo).flatten().slice(s, len(a)), cut(r), cut(ll), uid.slice(lo, hi - lo).take(pa.array(d)), pa.array(place[s : s + SLAB].astype(np.int32))],
                        ["key", "right", "left", "uid", "place"],
                    )

    return run


def _lce(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that two contexts share from their start on."""
    off = (x != y) | (x == 0)
    return np.where(off.any(1), off.argmax(1), x.shape[1])


class _Slab:
    """Consecutive suffixes in order, as arrays."""

    def __init__(self, key, right, left, uid, place):
        self.key, self.right, self.left, self.uid, self.place = key, right, left, uid, place

    def __len__(self) -> int:
        return len(self.key)

    def part(self, s) -> _Slab:
        return _Slab(self.key[s], self.right[s], self.left[s], self.uid[s], self.place[s])

    @staticmethod
    def joined(parts: list[_Slab]) -> _Slab:
        return _Slab(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("key", "right", "left", "uid", "place")))


def _right_most(s: _Slab, open_: np.ndarray) -> np.ndarray:
    """Words to the right that a suffix may share with another one of its key.  Suffixes come in right order, so
    its neighbours share the most; an open key's first and last suffix here may have neighbours elsewhere."""
    out = np.zeros(len(s), np.int64)
    same = s.key[1:] == s.key[:-1]
    near = np.where(same, _lce(s.right[1:], s.right[:-1]), 0)
    out[:-1] = near
    out[1:] = np.maximum(out[1:], near)
    edge = open_ & (np.concatenate(([True], ~same)) | np.concatenate((~same, [True])))
    out[edge] = _lce(s.right[edge], s.right[edge])
    return out


def _windows(s: _Slab, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, words left of the key and hash of each window of the suffixes that may have a copy, in row order."""
    width = s.right.shape[1]
    scale = powers(2 * width + 1)[1:]
    ahead, after = (np.zeros((len(s), width + 1), np.uint64) for _ in range(2))
    np.cumsum(s.left * scale[:width], axis=1, out=ahead[:, 1:])
    np.cumsum(s.right * scale[width:], axis=1, out=after[:, 1:])
    held = _lce(s.left, s.left)
    l = np.arange(width + 1)  # noqa: E741
    row, l = np.nonzero((l >= (width - most)[:, None]) & (l <= held[:, None]))  # noqa: E741
    return row, l, mix(mix(s.key.view(np.uint64)[row] + l.astype(np.uint64)) + ahead[row, l] + after[row, width - l])


FOUND = "uid long, lo long, hi long, other long, again boolean, window long, last long"


def _resolved(s: _Slab, open_: np.ndarray, least: int, key: int) -> Iterator[pa.RecordBatch]:
    """Regions of suffixes with copies; windows of open keys that have no earlier copy here go on by their hash, one for each piece."""
    most = _right_most(s, open_)
    order = np.lexsort((s.place, s.uid))
    s, open_, most = s.part(order), open_[order], most[order]
    row, l, h = _windows(s, most)  # noqa: E741
    order = np.argsort(h, kind="stable")  # copies of a window come by uid and place
    row, l, h = row[order], l[order], h[order]  # noqa: E741
    if not len(h):
        return
    uid, at = s.uid[row], s.place[row] - l
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    n = np.diff(np.append(start, len(h)))
    first, last = np.repeat(start, n), np.repeat(start + n - 1, n)
    again = (uid != uid[first]) | (at - at[first] >= least)
    later = (uid != uid[last]) | (at[last] - at >= least)
    names = [c.split()[0] for c in FOUND.split(", ")]
    for kind, mine, other in ((True, again, first), (False, later & ~again & ~open_[row], last)):
        x = np.flatnonzero(mine)
        if not len(x):
            continue
        # all windows of a suffix hold its key, so their union is one region
        x = x[np.argsort(row[x], kind="stable")]
        new = np.flatnonzero(np.concatenate(([True], row[x][1:] != row[x][:-1])))
        lo = np.minimum.reduceat(at[x], new)
        hi = np.maximum.reduceat(at[x], new) + least
        k = len(new)
        cols = [uid[x[new]], lo, hi, uid[other[x[new]]]]
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(k, kind)), none, none], names)
    x = np.flatnonzero(open_[row] & ~again)
    if len(x):
        y = last[x]
        cols = [uid[x], at[x], at[x] + least, uid[y]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(x), pa.bool_()), pa.array(h[x].view(np.int64)), pa.array(at[y])], names)


def _copies(least: int, key: int):
    width = least - key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # open: a key that may have suffixes elsewhere, as the first and last of a partition and those beyond a slab
        held, open_key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            words = lambda c: np.frombuffer(b"".join(c.to_pylist()), ">u4").reshape(-1, width).astype(np.uint32)  # noqa: E731, B023
            own = _Slab(b.column("key").to_numpy(), words(b.column("right")), words(b.column("left")), b.column("uid").to_numpy(), b.column("place").to_numpy().astype(np.int64))
            if open_key is None:
                open_key = own.key[0]
            held = own if held is None or not len(held) else _Slab.joined([held, own])
            cut = int(np.searchsorted(held.key, held.key[-1]))
            if not cut and len(held) > SLAB:
                cut, open_key = len(held), held.key[0]
            done, held = held.part(slice(0, cut)), held.part(slice(cut, None))
            if len(done):
                yield from _resolved(done, done.key == open_key, least, key)
        if held is not None and len(held):
            yield from _resolved(held, np.ones(len(held), bool), least, key)

    return run


def _met(found: DataFrame, least: int) -> DataFrame:
    """Windows of keys that lie in several pieces: an earlier or else a later copy makes a region.

    A piece gives a window once (and where a document's own copies overlap), so the rows of one hash are few."""
    by = Window.partitionBy("window")
    rows = found.where("window is not null").select(
        "uid", "lo", "hi", F.min(F.struct("uid", "lo")).over(by).alias("first"), F.max(F.struct(F.col("other").alias("uid"), F.col("last").alias("lo"))).over(by).alias("last")
    )
    again = F.expr(f"uid <> first.uid or lo - first.lo >= {least}")
    later = F.expr(f"uid <> last.uid or last.lo - lo >= {least}")
    return rows.where(again | later).select("uid", "lo", "hi", F.when(again, F.col("first.uid")).otherwise(F.col("last.uid")).alias("other"), again.alias("again"))


def passages(texts: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """uid, again, lo, hi, other: disjoint regions [lo, hi) of words of each of texts (uid, text) that
    stand elsewhere too; again: an earlier copy exists.  other: uid of one other copy."""
    spark = texts.sparkSession
    rows = texts.select("uid", text_bytes(F.col("text")).alias("text"))
    places = staged(rows.mapInArrow(_places(least, key), "key long, uid long, place int, reach short"), "places")
    by_doc = with_counts(places, "key", "c").groupBy("uid").agg(F.collect_list(F.struct("key", "place", "reach")).alias("p"))
    by_doc = by_doc.select("uid", F.col("p.key").alias("keys"), F.col("p.place").alias("places"), F.col("p.reach").alias("reaches"))
    suffixes = rows.join(by_doc, "uid").mapInArrow(_contexts(least, key), "key long, right binary, left binary, uid long, place int")
    order = ["key", "right", "left", "uid", "place"]
    met = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_copies(least, key), FOUND)
    met = staged(met, "matches")
    both = met.where("window is null").select("uid", "lo", "hi", "other", "again").union(_met(met, least))
    out = merged(both, ["uid", "again"], "other")
    out = staged(out, "passages")
    dropped(spark, places, met)
    return out


def repeats(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """doc_id, start_word, end_word, n_words, kept, other_doc_id: each repeated passage of each
    document; kept: no earlier copy of it exists.  other_doc_id holds the passage too."""
    texts = texts_of(numbered(docs))
    found = passages(texts, least, key)
    ids = texts.select("uid", "doc_id")
    own = found.join(ids, "uid").join(ids.select(F.col("uid").alias("other"), F.col("doc_id").alias("other_doc_id")), "other")
    return own.select("doc_id", F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), (F.col("hi") - F.col("lo")).alias("n_words"), (~F.col("again")).alias("kept"), "other_doc_id")


def without_repeats(docs: DataFrame, least: int = LEAST, key: int = KEY) -> DataFrame:
    """docs with later copies of passages cut from `text`, with the white space after them; rows that lose all their words go."""
    every = numbered(docs)
    again = staged(passages(texts_of(every), least, key).where("again").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cut")), "cuts")
    # only texts with a cut are shuffled
    some, rest = split(every, again.select("uid"), "uid")
    rows = some.join(again, "uid")
    # a word with the white space after it; no expression over the whole text may stand inside the filter
    space = r"[\x20\x09-\x0D]"
    rows = rows.withColumn("words", F.regexp_extract_all(F.col("row.text"), F.lit(rf"[^\x20\x09-\x0D]+{space}*"), F.lit(0)))
    ahead = F.regexp_extract("row.text", rf"^{space}*", 0)
    kept = F.concat(ahead, F.array_join(F.expr("filter(words, (w, j) -> not exists(cut, s -> j >= s.lo and j < s.hi))"), ""))
    some = rows.select(F.col("row").withField("text", kept).alias("row")).where(F.regexp_like("row.text", F.lit(r"[^\x20\x09-\x0D]")))
    return some.select("row.*").union(rest.select("row.*"))
