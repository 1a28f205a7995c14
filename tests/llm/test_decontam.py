"""Contamination against plain Python."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from strandline.llm import decontam
from strandline.llm.textops import ALNUM_WORD


def words(text):
    return re.findall(ALNUM_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(1)
    vocab = [f"v{k}" for k in range(50)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice((25, 12, 10, 9, 4, 1))))) for k in range(12)]
    items += [(3, "Ünï-Code, words: 7x & more!"), (90, None), (91, "  ,;"), (None, "null item text of eleven words so that it has two windows")]
    docs = [(k, " ".join(rng.choices(vocab, k=60))) for k in range(15)]
    for k in range(20, 40):
        item = items[k % len(items)][1] or ""
        docs.append((k, f"zz {item.upper()}!! yy {item} {item}"))
    docs += [(50, None), (51, ""), (None, "unïCode words 7X more"), (52, "x " * 3000 + (items[0][1] or "")), (20, docs[15][1])]
    return docs, items


def test_counts_equal_brute_force_by_both_joins(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, uid int").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, gram int")
    for most in (10**6, 0):
        got = sorted((tuple(r) for r in decontam.contamination(d, i, broadcast_grams=most).collect()), key=str)
        assert got == brute(docs, items)


def test_cut_texts_hold_no_window_and_clean_ones_stay(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, spans string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.without_hits(d, i)
    assert out.columns == d.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    for ident, n, hit, *_ in brute(docs, items):
        if not hit:
            assert any(ident == k for k, _ in kept)
    assert {(k, t) for k, t in docs if not any(b[0] == k and b[2] for b in brute(docs, items))} <= kept
    texts = dict(kept)
    for ident, n, hit, *_ in brute(docs, items):
        if hit and hit < n and ident is not None:
            assert len(words(texts[ident])) == n - hit
        if hit and hit == n:
            assert ident not in texts


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none, items = docs.where("false"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.contamination(docs, items).collect()] == [False]
    assert decontam.contamination(none, items).count() == 0 and decontam.without_hits(docs, items).count() == 1


def test_one_window_in_very_many_items_and_documents(spark):
    """Items and documents that share a window are not multiplied by each other."""
    shared = " ".join(f"s{k}" for k in range(10))
    items = spark.range(10_000).select(F.col("id").alias("item_id"), F.concat(F.lit(shared), F.lit(" own"), F.col("id")).alias("text"))
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.lit(shared), F.lit(" c"), F.when(F.col("id") == 7, " s1").otherwise("")).alias("text"))
    texts = docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    found, sets = decontam.hits(texts, items)
    assert sets.count() == 1 and found.where("found is not null").count() == 3_000
    for most in (decontam.BROADCAST_GRAMS, 0):
        got = decontam.contamination(docs, items, broadcast_grams=most).groupBy("n_hit", "n_items", "items_sha256").count().collect()
        want = hashlib.sha256(",".join(sorted(map(str, range(10_000)))).encode()).hexdigest()
        assert [tuple(r) for r in got] == [(10, 10_000, want, 3_000)]
