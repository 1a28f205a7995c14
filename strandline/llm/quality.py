"""Document quality by a sparse ensemble of rules over text statistics.

1. One pass over all whole texts gives the ``STATISTICS`` of each row, a narrow table that is written.
2. Rows with a label whose crc32(doc_id as text) modulo 3 is not 1 teach; of these the ``SAMPLE`` that
   stand first by a hash of doc_id and statistics come to the driver, as statistics alone.
3. Shallow trees are grown there, each on what the ones before leave unexplained.  Every path from
   a root to a node is a rule: bounds on some statistics that hold together.
4. A logistic lasso over the rules (and nothing else) keeps few of them with a weight.
5. The kept rules are compiled into one Spark column expression over the statistics, which scores all rows.

Nulls are empty texts; texts without words have statistics of zero and get the score of that.  Labels with
a null doc_id or quality teach nothing; a doc_id with several labels counts by their majority, good if
they tie, and all rows of a repeated doc_id teach.  Without a label of each kind the score is the
smoothed share of good labels.  Repeated rows each get their score.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .textops import chunks, grams, text_bytes, words_of

SAMPLE = 20_000  # labelled rows that teach, at most
TREES, DEPTH, CUTS, LEAF, SHRINK = 40, 3, 32, 10.0, 0.3
PENALTY, STEPS = 1e-3, 400

STATISTICS = (
    "n_bytes", "n_words", "n_lines", "word_length", "longest", "line_words",
    "upper", "digit", "space", "mark", "symbol", "wide",
    "shouted", "titled", "symbol_end", "stop_end", "no_letter", "short", "again", "top", "distinct", "grams_again", "lines_again",
)


def _classes() -> dict[str, np.ndarray]:
    of = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
    marks = of(b".,;:'\"-?()")
    ascii_ = np.arange(256) < 128
    named = {"upper": of(bytes(range(65, 91))), "lower": of(bytes(range(97, 123))), "digit": of(b"0123456789"), "space": of(b" \t\n\v\f\r"), "mark": marks, "wide": ~ascii_}
    return named | {"symbol": ascii_ & ~np.any(list(named.values()), axis=0) & (np.arange(256) > 32), "stop": of(b".!?")}


_CLASS = _classes()


def _firsts(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n texts the number of distinct values and how often the commonest one occurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))) if len(doc) else np.zeros(0, np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[start], np.diff(np.append(start, len(doc))))
    return np.bincount(doc[start], minlength=n), top


def _lines(offsets: np.ndarray, data: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the words of every line with a word."""
    if not len(w.doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    breaks = np.cumsum(data == 10)[w.start]
    start = np.flatnonzero(np.concatenate(([True], (breaks[1:] != breaks[:-1]) | (w.doc[1:] != w.doc[:-1]))))
    place = np.arange(len(w.doc)) - np.repeat(start, np.diff(np.append(start, len(w.doc))))
    return w.doc[start], np.add.reduceat(w.hash * (2 * place + 1).astype(np.uint64), start)


def statistics(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of a run of texts; sizes as logarithms, the others as shares or means."""
    n, size = len(offsets) - 1, np.diff(offsets)
    w = words_of(offsets, data)
    words = np.bincount(w.doc, minlength=n)
    share = lambda x, of: x / np.maximum(of, 1)
    sums = {c: np.concatenate(([0], np.cumsum(lut[data]))) for c, lut in _CLASS.items()}
    by_text = {c: s[offsets[1:]] - s[offsets[:-1]] for c, s in sums.items()}
    by_word = {c: s[w.end] - s[w.start] for c, s in sums.items()}
    counted = lambda mask: share(np.bincount(w.doc[mask], minlength=n), words)
    length, letters = w.end - w.start, by_word["upper"] + by_word["lower"] + by_word["wide"]
    last = data[w.end - 1] if len(w.end) else data[:0]
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc, length)
    again = np.zeros(len(w.doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    distinct, top = _firsts(w.doc, w.hash, n)
    g = grams(w.hash, 3)
    own = w.doc[: len(g)] == w.doc[2 : 2 + len(g)]
    n_grams = np.bincount(w.doc[: len(g)][own], minlength=n)
    line_doc, line = _lines(offsets, data, w)
    lines = np.bincount(line_doc, minlength=n)
    out = {
        "n_bytes": np.log1p(size), "n_words": np.log1p(words), "n_lines": np.log1p(lines),
        "word_length": share(np.bincount(w.doc, length, n), words), "longest": np.log1p(longest), "line_words": np.log1p(share(words, lines)),
        **{c: share(by_text[c], size) for c in ("upper", "digit", "space", "mark", "symbol", "wide")},
        "shouted": counted((by_word["upper"] > 1) & (by_word["lower"] == 0)),
        "titled": counted((by_word["upper"] > 0) & (by_word["lower"] > 0)),
        "symbol_end": counted(_CLASS["symbol"][last]), "stop_end": counted(_CLASS["stop"][last]),
        "no_letter": counted(letters == 0), "short": counted(length <= 2), "again": counted(again),
        "top": share(top, words), "distinct": share(distinct, words),
        "grams_again": share(n_grams - _firsts(w.doc[: len(g)][own], g[own], n)[0], n_grams),
        "lines_again": share(lines - _firsts(line_doc, line, n)[0], lines),
    }
    return {c: np.asarray(out[c], np.float64) for c in STATISTICS}


SCHEMA = ", ".join(["doc_id long", *(f"{c} double" for c in STATISTICS)])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, offsets, data in chunks(b.column("text")):
            own = statistics(offsets, data)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(own[c]) for c in STATISTICS)], ["doc_id", *STATISTICS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(_measured, SCHEMA)


class Rule(NamedTuple):
    """Bounds (statistic, above, at most), None where open, that hold together."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    @staticmethod
    def of(path: tuple[tuple[int, bool, float], ...]) -> Rule:
        """The tightest bounds of a path of (statistic, goes right, threshold)."""
        held: dict[int, tuple[float | None, float | None]] = {}
        for f, right, t in path:
            lo, hi = held.get(f, (None, None))
            held[f] = (t if lo is None else max(lo, t), hi) if right else (lo, t if hi is None else min(hi, t))
        return Rule(tuple((STATISTICS[f], *held[f]) for f in sorted(held)))

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c, lo, hi in self.bounds:
            v = x[:, STATISTICS.index(c)]
            out &= (lo is None or v > lo) & (hi is None or v <= hi)
        return out

    def sql(self) -> str:
        return " AND ".join(f"{c} {op} {float(t)!r}D" for c, lo, hi in self.bounds for op, t in ((">", lo), ("<=", hi)) if t is not None)


def _paths(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, rows: np.ndarray, depth: int, path: tuple) -> Iterator[tuple[tuple, np.ndarray, float]]:
    """Paths to all nodes below one, the rows of the leaves among them and their values."""
    best, at = 1e-6, None
    if depth:
        total, weight = slope[rows].sum(), bend[rows].sum()
        for f, own in enumerate(cuts):
            if not len(own):
                continue
            s, h = (np.cumsum(np.bincount(bins[rows, f], v[rows], len(own) + 1))[:-1] for v in (slope, bend))
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(own) + 1))[:-1]
            gain = s**2 / (h + 1) + (total - s) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (f, k)
    if at is None:
        yield path, rows, slope[rows].sum() / (bend[rows].sum() + 1)
        return
    f, k = at
    right = bins[rows, f] > k
    for side in (False, True):
        below = (*path, (f, side, float(cuts[f][k])))
        if depth > 1:
            yield below, rows[:0], 0.0
        yield from _paths(bins, cuts, slope, bend, rows[right == side], depth - 1, below)


def rules_of(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The paths of boosted trees over rows of STATISTICS with 0/1 labels."""
    cuts = []
    for v in x.T:
        some = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[1:-1]))
        some = np.unique(np.concatenate((some, [v.min()])))
        cuts.append(some[some < v.max()])
    bins = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    z, found = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        step = np.zeros(len(y))
        for path, rows, value in _paths(bins, cuts, y - p, p * (1 - p), np.arange(len(y)), depth, ()):
            step[rows] = value
            if path:
                found[Rule.of(path)] = None
        z += SHRINK * step
    return list(found)


def lasso(held: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise mean logistic loss + penalty * sum |weight|, by accelerated proximal steps."""
    n, m = held.shape
    held = held.astype(np.float32)
    v = np.ones(m + 1, np.float32)
    for _ in range(20):  # the largest curvature of the loss
        u = held @ v[:-1] + v[-1]
        v = np.append(held.T @ u, u.sum())
        top = np.linalg.norm(v)
        v = (v / top).astype(np.float32)
    rate = 4 * n / (1.05 * top)
    w = ahead = np.append(np.zeros(m), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    t = 1.0
    for _ in range(steps):
        z = held @ ahead[:-1].astype(np.float32) + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = ahead - rate * np.append(held.T @ off.astype(np.float32), off.sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


class Ensemble(NamedTuple):
    """Kept rules with their weights, and a constant."""

    rules: tuple[tuple[Rule, float], ...]
    constant: float

    def score(self) -> Column:
        """The chance of label 1 as an expression over columns of STATISTICS."""
        z = F.lit(self.constant)
        for rule, weight in self.rules:
            z = z + F.expr(f"IF({rule.sql()}, {float(weight)!r}D, 0D)")
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def learned(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Rules from labelled rows of stats (doc_id, STATISTICS); labels: doc_id, quality."""
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)) >= 0.5).cast("int").alias("good"))
    told = told.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = stats.join(told, "doc_id").orderBy(F.xxhash64("doc_id", *STATISTICS), "doc_id").limit(sample).select("good", *STATISTICS)
    table = known.toArrow()
    y = table.column("good").to_numpy().astype(float)
    n, good = len(y), y.sum()
    constant = float(np.log((good + 0.5) / (n - good + 0.5)))
    if not 0 < good < n:
        return Ensemble((), constant)
    x = np.column_stack([table.column(c).to_numpy() for c in STATISTICS])
    rules = rules_of(x, y)
    if not rules:
        return Ensemble((), constant)
    weights, constant = lasso(np.column_stack([r.holds(x) for r in rules]), y)
    return Ensemble(tuple((r, w) for r, w in zip(rules, weights.tolist(), strict=True) if w), constant)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (chance of label 1) and predicted for every row of docs (doc_id, text)."""
    stats = staged(measured(docs), "statistics")
    score = learned(stats, labels, sample).score()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return stats.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
