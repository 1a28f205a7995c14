"""Row numbers under scans that are split in other ways."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam, minhash, suffix_dedup

SPLIT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("op", ["near", "passages", "benchmark"])
def test_a_pass_under_another_split_finds_the_same_rows(spark, tmp_path, op):
    sha = "array_join(transform(sequence(1, {n}), k -> sha(concat({seed}, '-', k))), ' ')"
    own = sha.format(n="60 + id % 37", seed="id div 2")  # rows 2k and 2k + 1 repeat each other
    path = str(tmp_path / "docs")
    rows = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr(own).alias("text"))
    rows.repartition(12, "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    if op == "near":
        run = lambda: minhash.first_of_each(docs)
    elif op == "passages":
        run = lambda: suffix_dedup.without_repeats(docs)
    else:
        items = docs.where("doc_id in (6, 20, 41)").select(F.col("doc_id").alias("item_id"), "text")
        run = lambda: decontam.without_hits(docs, items)
    want = sorted(map(tuple, run().collect()))
    before = {c: spark.conf.get(c) for c in SPLIT}
    try:
        for c in SPLIT:
            spark.conf.set(c, "1000000")
        out = run()
        for c in SPLIT:
            spark.conf.set(c, "2000")
        got = sorted(map(tuple, out.collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == want
