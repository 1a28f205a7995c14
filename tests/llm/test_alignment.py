"""Token groups, links and counts against a plain version that walks bytes."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandline.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.exists(alignment.BYTE_BPE), reason="no tokenizer files")

SENTENCES = ["The quick brown fox's jumps, over 12345 lazy dogs!", "élan vital — naïve façade", "日本語のテキスト 混ざる", "a\n\n\n  b\t\tc   ", "<|endoftext|> and <s> or <unk> <0x41>", "🙂🙃 emoji 👩‍👩‍👧", "antidisestablishmentarianism pneumonoultramicroscopic", "x" * 50]


def plain(rows):
    """Results by owners of bytes: tokens overlap where they own a byte of the text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a_side, b_side = Tokenizer.from_file(alignment.BYTE_BPE), SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    a_side.encode_special_tokens = True
    of = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [b for b in range(256) if chr(b) not in of or of[chr(b)] != b]
    of |= {chr(256 + k): b for k, b in enumerate(rest)}
    assert decoders is not None
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = a_side.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in a_side.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(b_side.id_to_piece(t)[3:5], 16)]) if b_side.is_byte(t) else b_side.id_to_piece(t).replace("▁", " ").encode() for t in b]
        want = f" {text}".encode() if text else b""
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            a, b, a_bytes, b_bytes = [], [], [], []
        own_a = [k for k, x in enumerate(a_bytes) for _ in x]
        own_b = [k for k, x in enumerate(b_bytes) for _ in x]
        links = sorted(set(zip(own_a, own_b)))
        ends = sorted(set(np.cumsum([len(x) for x in a_bytes])) & set(np.cumsum([len(x) for x in b_bytes]))) if a else []
        lo, groups = 0, []
        for hi in ends:
            groups.append(",".join(str(a[k]) for k in sorted(set(own_a[lo:hi]))) + "|" + ",".join(str(b[k]) for k in sorted(set(own_b[lo:hi]))))
            lo = hi
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        docs.append((doc_id, len(a), len(b), groups, pairs))
    top = {}
    for (_, y), c in counts.items():
        top[y] = max(top.get(y, 0), c)
    out = []
    for doc_id, n_a, n_b, groups, pairs in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(counts[p] == top[p[1]] for p in pairs), sum(counts[p] for p in pairs), sha))
    return out, counts, top


def corpus():
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(SENTENCES, k=rng.randint(1, 6)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁ lower block"), (None, "no id"), (1, "repeated id"), (1, "repeated id"), (104, " " * 3000 + "x"), (105, "\x00 and �"), (106, "word " * 4000)]
    return rows


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
key = lambda r: tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("sizes", [(alignment.RUN_CHARS, alignment.CHUNK_LINKS), (60, 50), (400, 1), (1, 1000)])
def test_alignment_equals_plain_version(spark, sizes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "u", 1) for r in rows], "doc_id long, text string, uid string, chunk int").repartition(3)
    want, counts, top = plain(rows)
    got = alignment.alignment(docs, run_chars=sizes[0], chunk_links=sizes[1])
    assert got.columns == NAMES or set(got.columns) == set(NAMES)
    assert sorted(map(tuple, got.select(NAMES).collect()), key=key) == sorted(want, key=key)
    if sizes[1] == 50:
        pairs = alignment.pair_counts(docs, run_chars=60, chunk_links=50).collect()
        assert {(r.a, r.b): r["count"] for r in pairs} == counts and all(r.top == (r["count"] == top[r.b]) for r in pairs)
        groups = alignment.token_groups(docs.where("doc_id = 3"), run_chars=60).collect()
        written = ";".join(",".join(map(str, r.a)) + "|" + ",".join(map(str, r.b)) for r in groups)
        assert hashlib.sha256(written.encode()).hexdigest() in {w[-1] for w in want if w[0] == 3}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(docs).count() == 0 and alignment.pair_counts(docs).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r)[1:] for r in alignment.alignment(nothing).select(NAMES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_few_chunks_are_held_at_once(spark):
    """Row groups, which readers hold whole, have few chunks; pairs go back a row each, no task gathers lists of them."""
    docs = spark.createDataFrame([(k, f"{SENTENCES[0]} {k}") for k in range(60)], "doc_id long, text string").coalesce(1)
    chunks = alignment._counted(docs, alignment.BYTE_BPE, alignment.PIECE_BPE, alignment.RUN_CHARS, 30)[0]
    files = [pq.ParquetFile(f"{path}/{name}").metadata for path in [chunks.staged_path.removeprefix("file:")] for name in os.listdir(path) if name.endswith(".parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == chunks.count() > 20 and max(groups) <= 4
    plan = alignment.alignment(docs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("chunk_links", [alignment.CHUNK_LINKS, 1 << 40])
def test_many_rows_without_tokens(spark, chunk_links):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20000)) for _ in range(2)]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.range(10, 200010).selectExpr("id as doc_id", "cast(null as string) as text").coalesce(1)
    want = {tuple(r[n] for n in NAMES) for r in alignment.alignment(some).collect()}
    got = alignment.alignment(some.where("doc_id = 0").union(none).union(some.where("doc_id = 1")).coalesce(1), chunk_links=chunk_links)
    assert {tuple(r[n] for n in NAMES) for r in got.where("doc_id < 10").collect()} == want
    assert got.count() == 200002


def test_union_find_joins_random_graphs():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (5, 3), (200, 150), (300, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for x, y in zip(u.tolist(), v.tolist()):
            lo, hi = sorted((label[x], label[y]))
            label = [lo if z == hi else z for z in label]
        assert alignment.union_find(u, v, n).tolist() == label
    chain = np.arange(9999)
    assert not alignment.union_find(chain, chain + 1, 10000).any()


def test_parts_are_encoded_as_the_whole():
    text = " ".join(SENTENCES * 5)
    own = alignment.pair(alignment.BYTE_BPE, alignment.PIECE_BPE)
    parts = list(alignment.parts_of(text, 30))
    assert len(parts) > 10 and " ".join(parts) == text
    whole = own.encode(text)
    for side in (0, 1):
        assert np.concatenate([own.encode(p)[side] for p in parts]).tolist() == whole[side].tolist()
