"""Alignment of two tokenizers over the same texts.

1. Every whole text is encoded by both tokenizers, as a blank and the text.  Texts whose joined token
   bytes differ from that under either of them have no tokens.
2. Tokens of the two sides are the nodes of a bipartite graph, overlapping byte ranges its links.
   Union-find gives its components; as both sides tile the same bytes, a component ends exactly where
   both have a token's end, so components are the least groups.  A run of texts of about ``RUN_CHARS``
   is worked out side by side in numpy.
3. The members of the components give the links as pairs of ids.  A chunk of about ``CHUNK_LINKS`` links
   is one row: its distinct pairs with their counts, and for each document which of them it holds, packed
   into bytes that only the task that sums them unpacks.  A task reads ``CHUNKS_HELD`` chunks at a time.
   A pair is in a chunk's list once, so no pair is hot in the shuffle, however common it is.
4. Pairs are summed over the corpus, rated against the best pair of their B id (a row for each id of
   the vocabulary at most, broadcast) and sent back to their chunks, a row each.  Each chunk meets its rows
   by itself and sums them by document.

Texts longer than ``RUN_CHARS`` are encoded in parts that are cut between a character and a blank with a
letter after it, where neither tokenizer has a token across; the parts of a text count together.

Nulls and empty texts have no tokens: zeros and ''.  A null doc_id stays null; repeated rows and ids
are documents of their own and all count.  Other columns are ignored.  Without rows there are no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
RUN_CHARS, CHUNK_LINKS = 1 << 20, 1 << 20
CHUNKS_HELD = 4  # rows of a row group, which a reader holds whole
#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")


def byte_of_char() -> dict[str, int]:
    """Byte-level entries show a printable byte as itself and the others, in order, from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Byte-level BPE from a tokenizer file: ids of texts and bytes of ids.

    Where merges come in the order of their ids, as in the published vocabularies, the vocabulary alone says
    how to merge and the faster library does it, but for long runs of white space, on which it overflows."""

    LONG_SPACE = re.compile(r"\s{1000}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = byte_of_char(), spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(self.own.get_vocab().values()) + 1)
        for piece, k in self.own.get_vocab().items():
            self.bytes[k] = piece.encode() if piece in special else bytes(of[c] for c in piece)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab.get(a + b, -1) for a, b in merges]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if plain and not spec["model"].get("dropout") and order == sorted(set(order)):
            ranks = {self.bytes[k]: k for p, k in vocab.items() if p not in special}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not self.LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        return self.own.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """Pieces of a sentencepiece model; a blank is put before the text by the model."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = [self.own.id_to_piece(k) for k in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(piece)]

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text)


class Pair:
    """Both tokenizers, lengths of their tokens, and their ids as written in a group, with a separator after it."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), PieceBpe(b_path)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.written = np.array([f"{k}{s}" for n, seps in ((len(self.len_a), ",|"), (len(self.len_b), ",;")) for k in range(n) for s in seps], object)

    def encode(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B of a blank and the part; None if either's bytes are others."""
        want = f" {part}".encode()
        a, b = self.a.encode(f" {part}"), self.b.encode(part)
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def parts_of(text: str, most: int) -> Iterator[str]:
    """A text as parts of about `most` characters that both tokenizers encode as they do the whole; each stands after a blank."""
    lo = 0
    while len(text) - lo > most and (cut := CUT.search(text, lo + most)):
        yield text[lo : cut.start()]
        lo = cut.end()
    yield text[lo:]


def overlaps(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (A token, B token) that share bytes, for two rows of tokens over the same bytes."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    first = np.searchsorted(end_b, end_a - len_a, "right")
    n = np.searchsorted(end_b, end_a, "left") - first + 1
    left = np.repeat(np.arange(len(len_a)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first[left]


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component: roots of linked trees are joined, larger under smaller, and paths are halved until no link has two roots."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


class Groups:
    """Groups of a row of parts: for each A then each B token its component, named by its first A token, and the links."""

    def __init__(self, own: Pair, ids: list[tuple[np.ndarray, np.ndarray]]):
        self.a, self.b = (np.concatenate([x[k] for x in ids]) for k in (0, 1))
        self.left, self.right = overlaps(own.len_a[self.a], own.len_b[self.b])
        self.group = union_find(self.left, len(self.a) + self.right, len(self.a) + len(self.b))
        self.ends_a, self.ends_b = (np.cumsum([len(x[k]) for x in ids]) for k in (0, 1))
        self.n_links = np.diff(np.searchsorted(self.left, np.concatenate(([0], self.ends_a))))
        self.n_groups = np.diff(np.concatenate(([0], np.cumsum(self.group[: len(self.a)] == np.arange(len(self.a)))[self.ends_a - 1])))

    def written(self, own: Pair) -> list[str]:
        """Each part's groups as `a1,a2|b1;a3|b2`."""
        n = len(self.a)
        side = 2 * self.group
        side[n:] += 1
        order = np.argsort(side, kind="stable")
        last = np.concatenate((side[order][1:] != side[order][:-1], [True]))
        code = 2 * np.concatenate((self.a, self.b + len(own.len_a)))[order] + last
        text = own.written[code].tolist()
        ends = (self.ends_a + self.ends_b).tolist()
        return ["".join(text[lo:hi])[:-1] for lo, hi in zip([0, *ends], ends)]


def _runs(texts: list[str | None], most: int) -> Iterator[list[tuple[int, str, bool]]]:
    """Parts (text number, part, whether it is its text's last) in runs of about `most` characters; texts in order."""
    run, size = [], 0
    for k, text in enumerate(texts):
        own = list(parts_of(text or "", most))
        for j, part in enumerate(own):
            run.append((k, part, j == len(own) - 1))
            size += len(part)
            if size >= most:
                yield run
                run, size = [], 0
    if run:
        yield run


def _encoded(own: Pair, texts: list[str | None], most: int) -> Iterator[list[tuple[int, tuple[np.ndarray, np.ndarray] | None, bool]]]:
    """Runs with ids in the place of parts, None for texts without tokens.  The parts of a long text wait for the last one."""
    held: list = []
    for run in _runs(texts, most):
        held += [(k, own.encode(part) if texts[k] else None, last) for k, part, last in run]
        if held[-1][2]:
            bad = {k for k, ids, _ in held if ids is None}
            lo = size = 0
            for hi, (k, ids, _) in enumerate(held, 1):
                size += 0 if ids is None else len(ids[0])
                if size > most or hi == len(held):
                    yield [(k, None if k in bad else ids, last) for k, ids, last in held[lo:hi]]
                    lo, size = hi, 0
            held = []


KINDS = {"uid": "long", "doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "end": "int"}
CHUNK = ", ".join(f"{c}s array<{t}>" for c, t in KINDS.items()) + ", chunk long, at binary, pairs array<long>, counts array<int>"


def _chunks(a_path: str, b_path: str, run_chars: int, chunk_links: int):
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        rows, keys, held, number = [], [], 0, 0

        def row() -> pa.RecordBatch:
            """The links of all rows as places in the list of distinct pairs, in order and as differences, which take little space packed."""
            all_keys = np.concatenate([np.zeros(0, np.int64), *keys])
            pairs, at, counts = np.unique(all_keys, return_inverse=True, return_counts=True)
            n = np.array([r[-1] for r in rows], np.int64)
            at = np.sort(at + np.repeat(np.cumsum(n > 0) * (len(pairs) + 1), n))  # rows without links take no numbers, so differences are short
            packed = pa.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), codec="zstd", asbytes=True)
            cols = [pa.array([list(x)], pa.list_(kinds[t])) for x, t in zip(zip(*[(*r[:-1], e) for r, e in zip(rows, np.cumsum(n).tolist())]), KINDS.values(), strict=True)]
            cols += [pa.array([task + number]), pa.array([packed], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, [f"{c}s" for c in KINDS] + ["chunk", "at", "pairs", "counts"])

        uid = task
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            sha = hashlib.sha256()
            begun = False
            for parts in _encoded(own, texts, run_chars):
                some = [x for _, x, _ in parts if x is not None]
                g = Groups(own, some) if some else None
                written = iter(g.written(own) if g else ())
                j, first = -1, 0
                for k, x, last in parts:
                    if x is None:
                        if last:
                            rows.append((uid + k, ids[k], 0, 0, 0, 0, "", 0))
                            held += len(KINDS)
                            if held >= chunk_links:
                                yield row()
                                rows, keys, held, number = [], [], 0, number + 1
                        continue
                    j += 1
                    n = int(g.n_links[j])
                    sha.update((";" if begun else "").encode() + next(written).encode())
                    begun = not last
                    rows.append((uid + k, ids[k], len(x[0]), len(x[1]), int(g.n_groups[j]), n, sha.hexdigest() if last else None, n))
                    if last:
                        sha = hashlib.sha256()
                    s = slice(first, first + n)
                    keys.append(g.a[g.left[s]] << 32 | g.b[g.right[s]])
                    first, held = first + n, held + n + len(KINDS)
                    if held >= chunk_links:
                        yield row()
                        rows, keys, held, number = [], [], 0, number + 1
            uid += len(texts)
        if rows:
            yield row()

    return run


SUMS = "uid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(chunk: pa.Table, rated: pa.Table) -> pa.Table:
    """The parts of documents of a chunk with the sums over their links; rated: place, count and top of its pairs, in any order."""
    chunk = chunk.combine_chunks()
    at = lambda c: chunk.column(c).chunk(0)[0]
    ends, place = at("ends").values.to_numpy(), rated.column("place").to_numpy()
    count, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], top[place] = rated.column("count").to_numpy(), rated.column("top").to_numpy()
    links = np.frombuffer(pa.decompress(at("at").as_py(), 4 * int(ends[-1]), "zstd", asbytes=True), np.int32)
    places = np.cumsum(links, dtype=np.int64) % (len(place) + 1)
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[places])))[ends], prepend=0)
    cols = {c: at(f"{c}s").values for c in KINDS if c != "end"} | {"n_best": pa.array(sums(top)), "count_sum": pa.array(sums(count))}
    return pa.table({c: cols[c] for c in (s.split()[0] for s in SUMS.split(", "))})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(docs: DataFrame, a_path: str, b_path: str, run_chars: int, chunk_links: int) -> tuple[DataFrame, DataFrame]:
    """Chunks, and for each pair of ids its count and whether it is the best of its B id."""
    rows = _texts(docs).mapInArrow(_chunks(a_path, b_path, run_chars, chunk_links), CHUNK)
    chunks = staged(rows, "chunks", **{"parquet.block.row.count.limit": CHUNKS_HELD, "parquet.page.size.row.check.min": 1})
    listed = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = staged(listed.groupBy("pair").agg(F.sum("n").alias("count")), "counts").withColumn("b", F.expr("cast(pair & 4294967295 as int)"))
    best = counts.groupBy("b").agg(F.max("count").alias("best"))  # a row for each id of B's vocabulary at most
    return chunks, counts.join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("best")).alias("top"))


def pair_counts(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, run_chars: int = RUN_CHARS, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """a, b (ids of both vocabularies), count (links of the corpus) and top (no pair of that b has more)."""
    rated = _counted(docs, a_path, b_path, run_chars, chunk_links)[1]
    return rated.select(F.expr("cast(shiftright(pair, 32) as int)").alias("a"), F.expr("cast(pair & 4294967295 as int)").alias("b"), "count", "top")


def alignment(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, run_chars: int = RUN_CHARS, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text)."""
    chunks, rated = _counted(docs, a_path, b_path, run_chars, chunk_links)
    back = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(rated, "pair").select("of", "place", "count", "top")
    rows = chunks.drop("pairs", "counts").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_summed, SUMS)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return rows.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("uid")


def _grouped(a_path: str, b_path: str, run_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for b in batches:
            ids = b.column("doc_id")
            for parts in _encoded(own, b.column("text").to_pylist(), run_chars):
                some = [(k, x) for k, x, _ in parts if x is not None]
                if not some:
                    continue
                g = Groups(own, [x for _, x in some])
                n = len(g.a)
                first = np.flatnonzero(g.group[:n] == np.arange(n))
                lists = []
                for tokens, at in ((g.a, g.group[:n]), (g.b, g.group[n:])):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(first, n)).astype(np.int32)), pa.array(tokens.astype(np.int32))))
                doc = np.array([k for k, _ in some])[np.searchsorted(g.ends_a, first, "right")]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), *lists], ["doc_id", "a", "b"])

    return run


def token_groups(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, run_chars: int = RUN_CHARS) -> DataFrame:
    """doc_id, a, b: the ids of each least group of both tokenizers, in the order of the text within a task."""
    return _texts(docs).mapInArrow(_grouped(a_path, b_path, run_chars), "doc_id long, a array<int>, b array<int>")
