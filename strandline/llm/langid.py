"""Language of a text by compression.

Texts are lower-cased and what is no letter becomes one blank.  Each language gets a raw-content
zstandard dictionary of its training texts.  A text is compressed in blocks with each
dictionary; the language that needs the fewest bytes wins.  Where a quick level leaves the
runner-up within ``CLOSE`` a thorough level decides.  A text whose runner-up is then within
``margin`` of the winner (as a share of its bytes) is rejected.

The dictionaries are fitted on a bounded sample of labelled rows: of each language the
``SAMPLE_ROWS`` rows that stand first by a hash of doc_id and text, of each ``SAMPLE_CHARS`` characters
from a place that the hash picks in the whole text, at most ``MOST_LANGUAGES`` languages (more is an
error), so the driver holds a few MB.  Dictionaries are as long as the median language allows; a
language with less text keeps all of it, in a shorter dictionary.

Nulls and texts without a letter are `und` with score 0 and rejected.  A null lang teaches nothing.
Without any training row every prediction is `und`.  Ties go to the language with more training
rows, then to the one that sorts first, and are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGUAGES = 200, 2000, 100
BLOCK, QUICK, THOROUGH, CLOSE = 1 << 12, 3, 9, 0.03
MARGIN = 0.002


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the doc_id as text modulo n; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def letters(text: Column) -> Column:
    """Lower-cased runs of letters with one blank around each; null and texts without letters: one blank."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}]+", " ")


def dictionaries(training: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language of training (doc_id, text, lang), the language with most rows first."""
    known = training.where("lang is not null and text is not null").select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"), letters(F.col("text")).alias("w"))
    start = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.length("w") - chars, F.lit(0)) + 1).cast("int")
    first = known.select("lang", "doc_id", F.substr("w", start, F.lit(chars)).alias("piece"), "h")
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= rows)
    texts: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "k").collect():
        texts.setdefault(r["lang"], []).append(r["piece"].encode())
    if len(texts) > most:
        raise ValueError(f"{len(texts)} languages; at most {most} fit the bound of the sample")
    rows_of = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()} if texts else {}
    whole = {lang: b"".join(t) for lang, t in sorted(texts.items(), key=lambda x: (-rows_of[x[0]], x[0]))}
    size = max(1 << 13, sorted(len(t) for t in whole.values())[len(whole) // 2] if whole else 0)
    return {lang: t[:size] for lang, t in whole.items()}


def sizes(text: bytes, compressors: list, block: int = BLOCK) -> np.ndarray:
    """Bytes that each compressor needs for the blocks of the text."""
    parts = [text[i : i + block] for i in range(0, len(text), block)]
    return np.array([sum(len(c.compress(p)) for p in parts) for c in compressors], np.int64)


ADDED = "lang_pred string, score double, margin double, rejected boolean"


def language(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs (with a text) as they are, and after their columns lang_pred, score, margin and rejected."""
    names = list(dicts)
    fields = [f.split()[0] for f in ADDED.split(", ")]

    def told(text: bytes, levels: list[list]) -> tuple[str, float, float, bool]:
        for tools in levels:
            need = sizes(text, tools)
            best = int(need.argmin())
            rest = np.delete(need, best)
            if not len(rest):
                return names[best], 1.0, 1.0, False
            gap = float((rest.min() - need[best]) / need[best])
            if gap >= CLOSE:
                break
        return names[best], float(1 / (1 + np.exp2(-(rest - need[best]).astype(float)).sum())), gap, gap < margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = []
        for level in (QUICK, THOROUGH):
            levels.append([])
            for name in names:
                d = zstandard.ZstdCompressionDict(dicts[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                levels[-1].append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            rows = [told(t, levels) if names and t != b" " else ("und", 0.0, 0.0, True) for t in texts]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*kept, *fields])

    kept = docs.columns
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        letters(F.col("text")).cast("binary").alias("__bytes"),
    )
    added = T._parse_datatype_string(ADDED)
    return rows.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


def predicted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected for every row of docs (doc_id, text,
    lang), learned from rows whose remainder by 4 is not 2."""
    dicts = dictionaries(docs.where(remainder(F.col("doc_id"), 4) != 2))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = language(rows, dicts, margin)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def accepted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is told with a margin."""
    dicts = dictionaries(docs.where(remainder(F.col("doc_id"), 4) != 2))
    kept = docs.columns
    named = docs.toDF(*[f"c{k}" if c != "text" else c for k, c in enumerate(kept)])
    return language(named, dicts, margin).where("not rejected").select(*named.columns).toDF(*kept)
