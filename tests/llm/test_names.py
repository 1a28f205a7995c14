"""Extra columns under the names that the operators and Spark use inside change nothing."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontam, langid, minhash, mixing, staging, suffix_dedup, toxicity
from tests.llm.test_models import language

EXTRA = ["__uid", "_metadata", "uid", "row", "file", "place", "words", "spans", "cut", "found", "h", "key", "size", "draws", "block", "target", "__size", "sets", "n_words", "label"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    makers = [language(rng, k) for k in range(3)]
    texts = [makers[k % 3](rng.randint(5, 90)) for k in range(150)]
    texts += [texts[3]] * 4 + [texts[4] + " more"] * 3 + [f"{makers[0](30)} {texts[8]} {makers[0](60)} {texts[8]}" for _ in range(3)] + [None, "", "x"]
    rows = [(k, t, f"l{k % 3}", f"s{k % 4}", 0) for k, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("names")
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # a constant, the same for all rows: whoever takes it for a row number joins unlike rows
    plain.select("*", *[F.lit(7).cast("long").alias(c) for c in EXTRA]).repartition(3, "doc_id").write.parquet(str(folder / "extra"))
    extra = spark.read.parquet(str(folder / "extra"))
    items = spark.createDataFrame([(1, texts[5]), (2, texts[6][:60])], "item_id long, text string")
    items.write.parquet(str(folder / "benchmark.parquet"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 150, 2)], "doc_id long, toxic int")
    return extra.select(plain.columns), extra, items, labels, str(folder)


RUNS = {
    "op2": lambda d, items, labels: toxicity.toxicity(d, labels).select("doc_id", F.round("score", 9), "predicted"),
    "op3": lambda d, items, labels: mixing.mix_digest(d),
    "op6": lambda d, items, labels: langid.predicted(d).select("doc_id", "lang_pred"),
    "op8": lambda d, items, labels: decontam.contamination(d, items),
    "op9": lambda d, items, labels: suffix_dedup.repeats(d).select("doc_id", "start_word", "end_word", "kept"),
    "op10": lambda d, items, labels: minhash.near_duplicates(d).drop("uid"),
}


@pytest.mark.parametrize("op", sorted(RUNS))
def test_operators(tables, op):
    plain, extra, items, labels, _ = tables
    rows = lambda d: sorted(map(str, RUNS[op](d, items, labels).collect()))
    got = rows(extra)
    assert got == rows(plain) and got


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tables, stage):
    plain, extra, _, _, folder = tables
    name, run = corpus_pipeline.STAGES[stage]
    rows = lambda d: sorted(map(str, run(spark, d, folder).collect()))
    got = rows(extra)
    assert got == rows(plain) and got


def test_functions_keep_all_columns(tables):
    _, extra, items, _, _ = tables
    for out in (minhash.first_of_each(extra), suffix_dedup.without_repeats(extra), decontam.without_hits(extra, items), mixing.mixed(extra).drop("mix_pass", "mix_shard")):
        assert out.columns == extra.columns and {r["__uid"] for r in out.select("__uid").collect()} == {7}


def test_numbers_beyond_the_known_files(tables):
    plain = tables[0]
    for most in (staging.MOST_FILES, 1):
        rows = staging.numbered(plain, most)
        first = {r.uid: r.doc_id for r in rows.select("uid", "row.doc_id").collect()}
        assert len(first) == plain.count() and first == {r.uid: r.doc_id for r in rows.select("uid", "row.doc_id").collect()}
