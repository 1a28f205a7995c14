"""Subword lattice likelihood of documents.

The pieces come from an existing vocabulary file (a path; nothing of it is kept here) and make
a lattice over each word: every way to cut ``_word`` into pieces, characters that no piece has
being covered by byte pieces.  The vocabulary's order gives each piece its first score; one
round of expected counts over all training words (forward-backward over the lattice)
turns them into log-probabilities.  The score of a text is the logarithm of the sum over all
segmentations of all its words, by a forward recursion in log space, with a learned chance
that a text ends.  Pieces never cross white space, so the sum over the text is the product over
its words and each distinct word is worked out once.

1. Every task counts its words; the counts meet in a shuffle (a table of distinct words, which
   grows with the corpus and never leaves the executors).
2. Expected piece counts: one sum per piece and task, at most the vocabulary's size.
3. Each distinct word gets its count and its lattice probability.
4. A text sums its words.  The HOT most frequent words (a fixed number) are known to every task;
   the others of a text go to the word table in a join and come back as sums.

Words are separated by ASCII white space, A-Z in lower case.  One end follows each text and is a
token too.  Nulls and empty texts have the end alone.  Repeated rows are texts of their own.  A
null doc_id hashes as an empty text.  Without training rows counts are 0 and first scores stay;
no rows give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged
from .textops import FOLD, text_bytes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_PIECES = 500_000
HOT = 100_000
SMOOTH = 0.5
TALLY = 400_000  # distinct words that a task counts at a time
SPACE = "▁"
LN10 = math.log(10)


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of the file with first scores from their order; byte pieces as the characters U+0100 to U+01FF after a NUL."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if len(model) > MOST_PIECES:
        raise ValueError(f"{len(model)} pieces; at most {MOST_PIECES} are sent to tasks")
    kept = [k for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    order = sorted(kept, key=lambda k: (-model.get_score(k), k))
    harmonic = sum(1 / (r + 1) for r in range(len(order)))
    out = {}
    for r, k in enumerate(order):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            piece = f"\0{int(piece[3:5], 16):02x}"
        out[piece] = -math.log((r + 1) * harmonic)
    for b in range(256):  # a file without byte pieces still covers every text
        out.setdefault(f"\0{b:02x}", -math.log((len(order) + 1) * harmonic) - 1)
    return out


class Lattice:
    """All segmentations of a word into scored pieces, found by walking a tree of the pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.chars = {p for p in scores if len(p) == 1}
        self.root: dict = {}  # character -> (children, piece, score); piece is "" where none ends
        for piece in sorted((p for p in scores if p[0] != "\0"), key=len):
            node = self.root
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, "", 0.0])[0]
            node.setdefault(piece[-1], [{}, "", 0.0])[1:] = piece, scores[piece]

    def _bytes(self, c: str) -> tuple[str, float]:
        """Byte pieces of a character that has no piece of its own, and their score."""
        own = "".join(f"\0{b:02x}" for b in c.encode("utf-8", "surrogatepass"))
        return own, sum(self.scores[own[k : k + 3]] for k in range(0, len(own), 3))

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over segmentations of the word with its word mark."""
        text = SPACE + word
        n, chars, exp, log = len(text), self.chars, math.exp, math.log
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = 0.0
        for i in range(n):
            if i:
                t = terms[i]
                if len(t) == 1:
                    alpha = t[0]
                else:
                    top = max(t)
                    alpha = top + log(sum([exp(x - top) for x in t]))
                terms[i] = t = None
            if (c := text[i]) not in chars:
                terms[i + 1].append(alpha + self._bytes(c)[1])
            node, j = self.root, i
            while j < n and (found := node.get(text[j])) is not None:
                node, piece, score = found
                j += 1
                if piece:
                    terms[j].append(alpha + score)
        top = max(terms[n])
        return top + log(sum([exp(x - top) for x in terms[n]]))

    def expected(self, word: str, weight: float, out: dict[str, float]) -> None:
        """Adds weight times the expected counts of pieces in the word.

        The chance of an edge given that its end is on the path is what it gives to the sum at that
        end, so the backward pass needs the forward sums alone.
        """
        text = SPACE + word
        n, chars, exp, log = len(text), self.chars, math.exp, math.log
        into: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        for i in range(n + 1):
            if i:
                t = into[i]
                if len(t) == 1:
                    alpha[i] = t[0][1]
                else:
                    top = max([x[1] for x in t])
                    alpha[i] = top + log(sum([exp(x[1] - top) for x in t]))
                if i == n:
                    break
            a = alpha[i]
            if (c := text[i]) not in chars:
                own, score = self._bytes(c)
                into[i + 1].append((i, a + score, own))
            node, j = self.root, i
            while j < n and (found := node.get(text[j])) is not None:
                node, piece, score = found
                j += 1
                if piece:
                    into[j].append((i, a + score, piece))
        on_path = [0.0] * n + [weight]
        for end in range(n, 0, -1):
            g = on_path[end]
            if g < 1e-12:
                continue
            t = into[end]
            for start, total, piece in t:
                p = g if len(t) == 1 else g * exp(total - alpha[end])
                on_path[start] += p
                if piece[0] == "\0":
                    for k in range(0, len(piece), 3):
                        out[piece[k : k + 3]] = out.get(piece[k : k + 3], 0.0) + p
                else:
                    out[piece] = out.get(piece, 0.0) + p


def _text(word: bytes) -> str:
    return word.decode("utf-8", "replace")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(tallies) -> Iterator[pa.RecordBatch]:
        seen, train = tallies
        words = list(seen)
        for s in range(0, len(words), 50_000):
            part = words[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([train.get(w, 0) for w in part], pa.int64()), pa.array([seen[w] for w in part], pa.int64())], ["word", "c", "every"])

    tallies = Counter(), Counter()
    for b in batches:
        train = b.column("train").to_pylist()
        texts = b.column("text")
        for k, t in enumerate(train):
            words = texts[k].as_py().translate(FOLD).split()
            tallies[0].update(words)
            if t:
                tallies[1].update(words)
            if len(tallies[0]) > TALLY:
                yield from rows(tallies)
                tallies = Counter(), Counter()
    yield from rows(tallies)


def _expected(scores: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out = Lattice(scores), {}
        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("c").to_pylist(), strict=True):
                lattice.expected(_text(w), float(c), out)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.float64())], ["piece", "n"])

    return run


def _worked_out(scores: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(scores)
        for b in batches:
            logs = [lattice.log_probability(_text(w)) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs, pa.float64())], ["word", "c", "every", "log_p"])

    return run


def _summed(hot: dict[bytes, tuple[int, float, float]]):
    """Texts to token counts and sums over hot words; the other words with their counts stay listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = hot.get
        for b in batches:
            texts = b.column("text")
            n_tokens, known, base, lattice, ends, words, counts = [], [], [], [], [0], [], []
            for k in range(b.num_rows):
                tally = Counter(texts[k].as_py().translate(FOLD).split())
                n, n_known, s, p = 0, 0, [], []
                for w, c in tally.items():
                    n += c
                    if (h := get(w)) is None:
                        words.append(w)
                        counts.append(c)
                    else:
                        if h[0]:
                            n_known += c
                        s.append(c * h[1])
                        p.append(c * h[2])
                n_tokens.append(n)
                known.append(n_known)
                base.append(math.fsum(s))
                lattice.append(math.fsum(p))
                ends.append(len(words))
            cold = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("doc_id"), b.column("train"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lattice, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cold)],
                ["uid", "doc_id", "train", "n", "known", "base", "lattice", "cold"],
            )

    return run


def scored(docs: DataFrame, path: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and log10_per_token of every row of docs.

    Training rows are those whose crc32(doc_id as text) modulo 5 is not 1.  base_score is the
    smoothed word model; score is the lattice's log10 probability of the text.
    """
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), text_bytes(F.col("text")).alias("text"))
    counted = rows.select("train", "text").mapInArrow(_counted, "word binary, c long, every long")
    words = staged(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    texts = rows.where("train").count()  # ends
    n, v = sums["n"] + texts, sums["v"] + (1 if texts else 0)
    first = vocabulary(path)
    expected = words.where("c > 0").mapInArrow(_expected(first), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    seen = {r["piece"]: r["n"] for r in expected.collect()}  # at most a row a piece
    whole = sum(seen.values())
    prior = max(1.0, SMOOTH * len(first))  # pseudo-counts, shared out by the first scores
    scores = {p: math.log((seen.get(p, 0.0) + prior * math.exp(s)) / (whole + prior)) for p, s in first.items()}
    table = staged(words.mapInArrow(_worked_out(scores), "word binary, c long, every long, log_p double"), "lattice")
    base_of = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    # the most frequent words by steps of a sixteenth of an octave: the steps that together hold at most `hot` words
    step = F.floor(16 * F.log2("every")).cast("int")
    steps, least, room = table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect(), None, hot
    for r in steps:
        if r["count"] > room:
            break
        least, room = r["step"], room - r["count"]
    top = table.where(step >= least).collect() if least is not None else []
    known = {bytes(r["word"]): (r["c"], base_of(r["c"]), r["log_p"]) for r in top}
    parts = staged(rows.mapInArrow(_summed(known), "uid long, doc_id long, train boolean, n long, known long, base double, lattice double, cold array<struct<word:binary,n:long>>"), "parts")
    cold = parts.select("uid", F.explode("cold").alias("w")).select("uid", "w.word", "w.n").join(table.select("word", "c", "log_p"), "word")
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    rest = cold.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * base).alias("base2"), F.sum(F.col("n") * F.col("log_p")).alias("lattice2")
    )
    end = (texts + 0.5) / (n + 1)
    both = parts.drop("cold").join(rest, "uid", "left").na.fill(0, ["known2", "base2", "lattice2"])
    out = both.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.col("known2") + (1 if texts else 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base2") + base_of(texts)).alias("base_score"),
        ((F.col("lattice") + F.col("lattice2") + F.col("n") * math.log1p(-end) + math.log(end)) / LN10).alias("score"),
    )
    return out.withColumn("log10_per_token", F.col("score") / F.col("n_tokens"))
