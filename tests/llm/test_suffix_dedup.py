"""Repeated passages against every window of fifty words."""

import random

import numpy as np
import pytest

from strandline.llm import suffix_dedup as sd


def covered(rows, least=50):
    """Words of each row (by place in the list) inside a window of `least` words that stands elsewhere, not overlapping in the same row."""
    seen = {}
    split = [(t or "").lower().split() for t in rows]
    for k, w in enumerate(split):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((k, i))
    out = [set() for _ in rows]
    for places in seen.values():
        for k, i in places:
            if any(o != k or abs(j - i) >= least for o, j in places):
                out[k] |= set(range(i, i + least))
    return out


def corpus():
    rng = random.Random(11)
    vocab = [f"t{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    long, short, line = text(240), text(52), text(30)
    rows = [text(n) for n in (10, 49, 50, 300, 800)]
    rows += [f"{text(rng.randint(0, 90))} {long} {text(rng.randint(0, 90))}" for _ in range(6)]
    rows += [f"{text(rng.randint(20, 90))}\n{short.upper()}  {text(40)}" for _ in range(60)]
    rows += [f"{text(60)} {line} {text(60)}" for _ in range(80)]
    rows += [rows[3], rows[3], None, "", f"{short} middle {text(70)} {short}"]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(rows)], "doc_id long, text string, uid int, lo string").coalesce(2)


@pytest.mark.parametrize("slab", [sd.SLAB, 37])
def test_regions_equal_brute_force(spark, monkeypatch, slab):
    monkeypatch.setattr(sd, "SLAB", slab)
    rows = corpus()
    got = [set() for _ in rows]
    kept = [set() for _ in rows]
    for r in sd.repeats(frame(spark, rows)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        (kept[r.doc_id] if r.kept else set()).update(range(r.start_word, r.end_word))
    want = covered(rows)
    assert got == want
    assert sum(map(len, kept)) > 0


def test_cut_corpus_keeps_one_copy(spark):
    rows = corpus()
    out = sd.without_repeats(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "uid", "lo"]
    left = {r.doc_id: r.text for r in out.collect()}
    assert not any(covered(list(left.values())))
    want = covered(rows)
    for k, t in enumerate(rows):
        if not want[k]:
            assert left[k] == t
    words = {w for t in rows for w in (t or "").lower().split()}
    assert {w for t in left.values() for w in (t or "").lower().split()} == words


def test_selected_places_hold_in_every_window():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 50, 400).astype(np.uint64)
    at = sd._selected(g, np.ones(400, bool), 26)
    assert all(((at >= i) & (at < i + 26)).any() for i in range(400 - 25)) and len(at) < 200


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.repeats(docs).count() == 0 and sd.without_repeats(docs).count() == 0


def first_and_later(rows, least=50):
    """Words of each row in windows with no earlier but a later copy, and in windows with an earlier one."""
    seen = {}
    split = [(t or "").lower().split() for t in rows]
    for k, w in enumerate(split):
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((k, i))
    kept, again = [set() for _ in rows], [set() for _ in rows]
    for places in seen.values():
        (fk, fi), (lk, li) = places[0], places[-1]
        for k, i in places:
            if k != fk or i - fi >= least:
                again[k] |= set(range(i, i + least))
            elif k != lk or li - i >= least:
                kept[k] |= set(range(i, i + least))
    return kept, again


@pytest.mark.parametrize(("slab", "parts"), [(sd.SLAB, 1), (37, 1), (37, 13), (sd.SLAB, 13)])
def test_kept_words_equal_brute_force(spark, monkeypatch, slab, parts):
    monkeypatch.setattr(sd, "SLAB", slab)
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices([f"v{k}" for k in range(3000)], k=n))
    hot, period = text(60), text(60)
    rows = corpus() + [f"{text(30)} {hot} {text(30)}" for _ in range(150)] + [f"{period} {period} {period}"]
    # copies whose partner is next to them in neither order: words shared on both sides of a hot key
    line, sides = text(30), [(text(12), text(12)) for _ in range(40)]
    rows += [f"{text(30)} {a} {line} {b} {text(30)}" for a, _ in sides for _, b in rng.sample(sides, 4)]
    docs = frame(spark, rows).coalesce(1)  # so that rows are numbered in order
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for c, v in zip(before, ("false", str(parts), "50"), strict=True):
            spark.conf.set(c, v)
        found = sd.repeats(docs).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    kept, again = [set() for _ in rows], [set() for _ in rows]
    for r in found:
        (kept if r.kept else again)[r.doc_id].update(range(r.start_word, r.end_word))
    assert (kept, again) == first_and_later(rows)
