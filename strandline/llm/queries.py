"""The registered queries of this subpackage, and DuckDB SQL where SQL can express one.

Each callable takes (spark, sf_dir) and works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, langid, lattice, licenses, lsh, minhash, mixing, quality, ranking, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment.alignment(_table(spark, sf_dir, "documents")).select(columns)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_lattice": op1_lattice,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_lsh": op5_lsh,
    "op6_language": op6_language,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_quality": op12_quality,
    "op13_ranking": op13_ranking,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
b AS (
  SELECT page_id, n, x,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), 'string_agg', '') AS digest
  FROM d),
f AS (SELECT x, max(page_id) AS first_id, count(*) AS c FROM d GROUP BY x)
SELECT b.page_id, b.n AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN b.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN b.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM b JOIN f USING (x)
"""

_OP8 = f"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, k + 1, k + least(len(w), 10)), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
s AS (
  SELECT u, n, k, array_to_string(list_slice(w, k + 1, k + n), ' ') AS gram
  FROM (SELECT u, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT s.u, s.k, s.n, g.item_id FROM s JOIN g USING (n, gram)),
c AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT u, k, n FROM h)) GROUP BY u),
m AS (
  SELECT u, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT u, item_id FROM h) GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (u) LEFT JOIN m USING (u)
"""

_OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id,
    regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (
  SELECT DISTINCT u, item_id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS u, * FROM benchmark WHERE text IS NOT NULL)),
p AS (
  SELECT u, doc_id, n, term, count(*) AS tf FROM (SELECT u, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY u, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
r AS (
  SELECT q.u, q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * p.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.u, q.item_id, p.u, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY u ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, doc_id NULLS LAST) <= 50
"""

#: The others train models, draw at random or follow chains of links; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_warc": _OP4, "op8_decontamination": _OP8, "op13_ranking": _OP13}
