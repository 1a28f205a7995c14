"""The pipeline on a small corpus: what each stage decides takes effect."""

import random

import corpus_pipeline
from tests.llm.test_models import language


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "passages", "decontamination", "mix"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    makers = [language(rng, k) for k in range(3)]
    rows = [(k, makers[k % 3](rng.randint(30, 90)), f"l{k % 3}", f"s{k % 4}", 0) for k in range(300)]
    passage = makers[0](70)
    rows += [(1000 + k, rows[3][1], "l0", "s1", 0) for k in range(5)]
    rows += [(2000 + k, f"{makers[1](30)} {passage} {makers[1](30)}", "l1", "s2", 0) for k in range(4)]
    leak = makers[2](25)
    rows += [(3000, f"{makers[2](40)} {leak} {makers[2](40)}", "l2", "s0", 0), (4000, None, None, None, None), (4001, "12345", "l0", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == corpus_pipeline.COLUMNS, name
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    left = {r.doc_id: r.text for r in kept.collect()}
    assert not {4000, 4001} & set(left) and not {1000 + k for k in range(5)} & set(left) and 3 in left
    assert sum(passage in t for t in left.values()) == 1 and leak not in left[3000]
    assert sum(k in left for k in range(300)) >= 297
    mix = corpus_pipeline.run(spark, str(tmp_path))
    assert mix.columns == [*corpus_pipeline.COLUMNS, "mix_pass", "mix_shard"]
    assert {r.doc_id for r in mix.collect()} <= set(left)


def test_pipeline_over_empty_tables_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(2)
    make = language(rng, 0)
    rows = [(7, make(60), "l0", "s", 0) for _ in range(6)] + [(None, make(40), "l0", None, 0) for _ in range(3)] + [(7, None, None, None, None)]
    for name, table, items in (("none", [], []), ("no-items", rows, []), ("repeated", rows, [(1, None), (None, "zz yy")])):
        spark.createDataFrame(table, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        # unlike texts of one id are documents of their own; rows without a text go
        assert {r.text for r in out} <= {r[1] for r in table if r[1]} and (not table or out)
