"""Toxic spans by a linear-chain conditional random field.

Learning, from labelled rows whose crc32(doc_id as text) modulo 5 is not 0:

1. Over all rows with remainder 2, 3 or 4 each distinct word and word head (4 to 8 letters)
   is counted in toxic and in clean documents.  The ``MOST_FEATURES`` that a likelihood
   ratio test ties most to toxic documents are the features; a token of a toxic document with
   a feature of precision ``PRECISE`` or more is labelled 1, every other token 0.
2. The field (two states, transitions, a bias and a weight per feature) is fitted by gradient
   ascent on windows of ``WINDOW`` tokens.  The texts of at most ``SAMPLE`` labelled rows are cut
   into windows as wholes; of the windows of toxic and of clean rows the ``SAMPLE_WINDOWS`` that stand
   first by a hash of row and place are taken.
3. Rows with remainder 1, at most ``SAMPLE``, calibrate the document score: a logistic
   function of the sum of the marginals, its share of the tokens and the largest one.

Scoring runs forward-backward over every whole text, all texts of a run of about 1 MB side by
side, and gives the score, the prediction and the character offsets of tokens whose marginal
is at least 0.5.  The model (at most MOST_FEATURES weights) travels with the function.

Nulls and texts without words have no marginals and get the calibrated score of that.  Labels
with a null doc_id or toxic value teach nothing; a doc_id labelled more than once counts as
toxic if any label says so, and all rows of a repeated doc_id teach.  Without a label of each kind the score is the smoothed share of
toxic labels.  Repeated rows each get their score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rowsets import picked, split
from .staging import local_table, numbered, staged, texts_of
from .textops import ALNUM_FOLD, text_bytes

MOST_FEATURES, SAMPLE, SAMPLE_WINDOWS = 5000, 2000, 6000
HEADS = (4, 5, 6, 7, 8)
LEAST_RATIO, PRECISE = 12.0, 0.8
WINDOW, STEPS, RATE, PENALTY = 96, 60, 0.4, 1e-3
MEMO = 300_000  # words whose weight a task remembers
RUN_BYTES = 1 << 20
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text: bytes) -> list[str]:
    """Runs of letters, digits and non-ASCII characters (white space beyond ASCII too, as in TOKEN), lower-cased."""
    return [w for w in text.translate(ALNUM_FOLD).decode("utf-8", "replace").lower().split(" ") if w]


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}-" for n in HEADS if len(word) > n)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = {}, {}
    names = ["feature", "toxic", "clean"]

    def rows() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()), pa.array([clean.get(k, 0) for k in keys], pa.int64())], names)

    for b in batches:
        for text, label in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
            tally = toxic if label else clean
            for f in {f for w in set(tokens(text.as_py())) for f in features_of(w)}:
                tally[f] = tally.get(f, 0) + 1
            if len(toxic) + len(clean) > MEMO:
                yield rows()
                toxic.clear(), clean.clear()
    yield rows()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as windows of WINDOW tokens."""
    for b in batches:
        for uid, toxic, text in zip(b.column("uid").to_pylist(), b.column("toxic").to_pylist(), b.column("text"), strict=True):
            words = tokens(text.as_py())
            at = range(0, len(words), WINDOW)
            for s in range(0, len(at), 1000):
                own = at[s : s + 1000]
                cols = [pa.array([x] * len(own), t) for x, t in ((uid, pa.int64()), (toxic, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.int32()), pa.array([words[k : k + WINDOW] for k in own], pa.list_(pa.string()))], ["uid", "toxic", "at", "words"])


class Field:
    """Weights of the features, bias of state 1 and transition scores [from, to]."""

    def __init__(self, weights: dict[str, float], bias: float, step: np.ndarray):
        self.weights, self.bias, self.step = weights, bias, step

    def emissions(self, words: list[str], memo: dict[str, float]) -> list[float]:
        out = []
        for w in words:
            e = memo.get(w)
            if e is None:
                get = self.weights.get
                e = memo[w] = self.bias + sum(get(f, 0.0) for f in features_of(w))
            out.append(e)
        return out

    def marginals(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Chance of state 1 for each token of each row of emissions; rows side by side, longest first."""
        n = np.array([len(r) for r in rows])
        order = np.argsort(-n, kind="stable")
        flat = np.zeros(int(n.sum()))
        longest = int(n.max(initial=0))
        if not longest:
            return [np.zeros(0) for _ in rows]
        alive = len(rows) - np.searchsorted(np.sort(n), np.arange(longest), "right")
        first = np.concatenate(([0], np.cumsum(alive)))
        place = [first[: n[k]] + j for j, k in enumerate(order)]
        for j, k in enumerate(order):
            flat[place[j]] = rows[k]
        odds = np.exp(np.clip(flat, -50, 50))
        (a00, a01), (a10, a11) = np.exp(self.step)
        ahead, behind = np.empty_like(flat), np.ones_like(flat)
        ahead[: alive[0]] = odds[: alive[0]]
        for t in range(1, longest):
            r = ahead[first[t - 1] : first[t - 1] + alive[t]]
            ahead[first[t] : first[t + 1]] = odds[first[t] : first[t + 1]] * ((a01 + a11 * r) / (a00 + a10 * r))
        for t in range(longest - 2, -1, -1):
            q = odds[first[t + 1] : first[t + 2]] * behind[first[t + 1] : first[t + 2]]
            behind[first[t] : first[t] + alive[t + 1]] = (a10 + a11 * q) / (a00 + a01 * q)
        both = ahead * behind
        p = both / (1 + both)
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        for j, k in enumerate(order):
            out[k] = p[place[j]]
        return out


def fitted(texts: list[list[str]], labels: list[list[int]], features: list[str]) -> Field:
    """A field for rows of at most some hundred tokens and their 0/1 labels, by full-batch gradient ascent on the log-likelihood."""
    number = {f: k for k, f in enumerate(features)}
    rows, ys = [t for t in texts if t], [y for t, y in zip(texts, labels, strict=True) if t]
    if not rows:
        return Field({}, -4.0, np.zeros((2, 2)))
    longest = max(map(len, rows))
    y, mask = np.zeros((longest, len(rows)), np.int64), np.zeros((longest, len(rows)), bool)
    at, which = [], []
    for j, (words, own) in enumerate(zip(rows, ys, strict=True)):
        y[: len(own), j], mask[: len(own), j] = own, True
        for t, w in enumerate(words):
            for f in features_of(w):
                if (k := number.get(f)) is not None:
                    at.append(t * len(rows) + j)
                    which.append(k)
    at, which = np.array(at, np.int64), np.array(which, np.int64)
    both = mask[1:]
    pair = np.array([[((y[:-1] == a) & (y[1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta, bias, step = np.zeros(len(features)), -4.0, np.log((pair + 1) / (pair + 1).sum(1, keepdims=True))
    seen, seen_f = float((y * mask).sum()), np.bincount(which, weights=y.ravel()[at], minlength=len(features))
    scale_f = np.maximum(np.bincount(which, minlength=len(features)), 1)
    tokens_, pairs = max(float(mask.sum()), 1), max(float(both.sum()), 1)
    for _ in range(STEPS):
        e = np.full(y.size, bias)
        np.add.at(e, at, theta[which])
        emit = np.stack((np.zeros(y.shape), np.clip(e.reshape(y.shape), -30, 30)), 2)
        trans = np.exp(step)
        local = np.exp(emit - emit.max(2, keepdims=True))
        alpha, beta = np.empty_like(local), np.ones_like(local)
        alpha[0] = local[0] / local[0].sum(1, keepdims=True)
        for t in range(1, longest):
            a = (alpha[t - 1] @ trans) * local[t]
            alpha[t] = np.where(mask[t][:, None], a / a.sum(1, keepdims=True), alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            b = (local[t + 1] * beta[t + 1]) @ trans.T
            beta[t] = np.where(mask[t + 1][:, None], b / b.sum(1, keepdims=True), 1.0)
        p = alpha * beta
        p = (p / p.sum(2, keepdims=True))[:, :, 1] * mask
        xi = np.zeros((2, 2))
        for t in range(1, longest):
            x = alpha[t - 1][:, :, None] * trans * (local[t] * beta[t])[:, None, :]
            xi += (x / x.sum((1, 2), keepdims=True))[both[t - 1]].sum(0)
        theta += RATE * 4 * ((seen_f - np.bincount(which, weights=p.ravel()[at], minlength=len(features))) / scale_f - PENALTY * theta)
        bias += RATE * 4 * (seen - p.sum()) / max(seen, 0.002 * tokens_)
        bias = float(np.clip(bias, -12, 4))
        step = step + RATE * (pair - xi) / np.maximum(pair.sum(1, keepdims=True), 1)
    return Field({f: float(theta[k]) for f, k in number.items() if theta[k]}, bias, step)


def gathered(marginals: np.ndarray) -> tuple[float, float, float]:
    """Sum of the marginals, share of the tokens and largest marginal, as logarithms and odds."""
    total, n = float(marginals.sum()), len(marginals)
    return np.log(total + 0.05), np.log((total + 0.05) / (n + 20)), float(marginals.max(initial=0.0))


def calibrated(x: np.ndarray, y: np.ndarray, penalty: float = 0.02) -> np.ndarray:
    """Weights of a logistic function (the first one constant), by Newton steps."""
    z = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(z.shape[1])
    ridge = penalty * len(z) / 100 * np.diag([0.0] + [1.0] * x.shape[1]) + 1e-6 * np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - ridge @ w), -3, 3)
    return w


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Field, np.ndarray]:
    """The field and the calibration from labelled rows; docs: doc_id, text; labels: doc_id, toxic."""
    every = texts_of(numbered(docs))
    told = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    rest = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    rows = every.select("uid", F.col("doc_id").cast("long").alias("doc_id")).where(rest != 0)
    # numbers of labelled rows: narrow, so texts are never shuffled for their labels
    marks = staged(rows.join(told, "doc_id").select("uid", "toxic", rest.alias("fold")), "marks")
    texts = every.select("uid", text_bytes(F.col("text")).alias("text"))
    count: dict[tuple[bool, bool], int] = {}
    for r in marks.groupBy("toxic", "fold").count().collect():
        key = r["toxic"], r["fold"] == 1
        count[key] = count.get(key, 0) + r["count"]
    n1, n0 = count.get((True, False), 0), count.get((False, False), 0)
    every1 = n1 + count.get((True, True), 0)
    every = every1 + n0 + count.get((False, True), 0)
    base = np.array([np.log((every1 + 0.5) / (every - every1 + 0.5)), 0.0, 0.0, 0.0])
    if not n1 or not n0:
        return Field({}, -4.0, np.zeros((2, 2))), base
    some = picked(texts, marks.where("fold <> 1").select("uid"), "uid")
    toxic, clean = split(some, marks.where("toxic").select("uid"), "uid")
    known = toxic.select("text", F.lit(True).alias("toxic")).union(clean.select("text", F.lit(False).alias("toxic")))
    counts = known.mapInArrow(_counted, "feature string, toxic long, clean long")
    sums = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a >= 2")
    n, m = F.col("a") + F.col("b"), float(n1 + n0)
    part = lambda x, share: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * F.lit(share)))).otherwise(0.0)
    rated = sums.withColumn("g", 2 * (part("a", n1 / m) + part("b", n0 / m))).where((F.col("g") >= LEAST_RATIO) & (F.col("a") / n > n1 / m))
    best = rated.orderBy(F.desc("g"), "feature").limit(MOST_FEATURES).collect()
    precise = {r["feature"] for r in best if r["a"] >= PRECISE * (r["a"] + r["b"])}
    features = [r["feature"] for r in best]

    def sample(rows: DataFrame, k: int) -> DataFrame:
        """uid, text and toxic of the k rows that stand first by a hash: numbers first, then their texts."""
        first = rows.orderBy(F.xxhash64("uid"), "uid").limit(k).select("uid", F.col("toxic").cast("int").alias("toxic"))
        got = first.collect()
        few = local_table(docs.sparkSession, {"uid": pa.array([r["uid"] for r in got], pa.int64()), "toxic": pa.array([r["toxic"] for r in got], pa.int32())})
        return texts.join(F.broadcast(few), "uid").select("uid", "toxic", "text")  # k rows

    train = []
    for of in ("toxic", "not toxic"):
        windows = sample(marks.where("fold <> 1").where(of), SAMPLE // 2).mapInArrow(_windows, "uid long, toxic int, at int, words array<string>")
        train += windows.orderBy(F.xxhash64("uid", "at"), "uid", "at").limit(SAMPLE_WINDOWS).collect()
    rows = [r["words"] for r in train]
    ys = [[int(r["toxic"] > 0 and any(f in precise for f in features_of(w))) for w in r["words"]] for r in train]
    field = fitted(rows, ys, features)
    held = sample(marks.where("fold = 1"), SAMPLE).select("uid", "toxic", "text").mapInArrow(_gathered(field), "uid long, toxic int, total double, share double, top double")
    x = held.orderBy("uid").collect()
    if not x or len({r["toxic"] > 0 for r in x}) < 2:
        return field, base
    return field, calibrated(np.array([[r["total"], r["share"], r["top"]] for r in x]), np.array([float(r["toxic"] > 0) for r in x]))


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about RUN_BYTES."""
    start, run, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_py()
        if run and size + len(t) > RUN_BYTES:
            yield start, run
            start, run, size = k, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def _marginals(field: Field, texts: list[bytes], memo: dict) -> list[np.ndarray]:
    if len(memo) > MEMO:
        memo.clear()
    return field.marginals([np.array(field.emissions(tokens(t), memo)) for t in texts])


def _gathered(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for b in batches:
            for lo, texts in _runs(b.column("text")):
                x = np.array([gathered(p) for p in _marginals(field, texts, memo)])
                own = [b.column(c).slice(lo, len(texts)) for c in ("uid", "toxic")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x[:, k]) for k in range(3))], ["uid", "toxic", "total", "share", "top"])

    return run


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>"


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (character offsets of toxic tokens with their marginals) of every row of docs."""
    field, w = learned(docs, labels)

    def spans(text: bytes, p: np.ndarray) -> list[dict]:
        if not (p >= 0.5).any():
            return []
        found = [m.span() for m in TOKEN.finditer(text.decode("utf-8", "replace"))]
        return [{"start": found[k][0], "end": found[k][1], "p": float(p[k])} for k in np.flatnonzero(p >= 0.5) if k < len(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            for lo, texts in _runs(b.column("text")):
                ps = _marginals(field, texts, memo)
                x = np.array([gathered(p) for p in ps])
                score = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
                own = [spans(t, p) for t, p in zip(texts, ps, strict=True)]
                cols = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(own, kind)]
                yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, len(texts)) for c in ("doc_id", "held_out")] + cols, ["doc_id", "held_out", "score", "predicted", "spans"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes(F.col("text")).alias("text")).mapInArrow(run, SCHEMA)
