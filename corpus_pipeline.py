"""A corpus pipeline of five stages; see STAGES.

Every stage works on all rows that the one before has kept, and its decisions take effect:
rejected documents go, one document of each group of near copies stays, later copies of
long passages and benchmark windows are cut from the texts (a document goes only if no word
is left), and the last stage returns the mix: a row for each time that it takes a document, with
the pass over its source and the output shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, minhash, mixing, suffix_dedup
from strandline.llm.staging import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin stay."""
    return langid.accepted(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.first_of_each(docs).select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside windows of the benchmark go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.without_hits(docs, items).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights; columns of documents, mix_pass and mix_shard."""
    return mixing.mixed(docs.select(COLUMNS))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("passages", passages),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: The stages train models and follow chains of links, which SQL does not express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order, each to the rows that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
