"""Benchmark decontamination with DataFrame functions only.

Windows of n consecutive words of the items (an item with fewer words is one window) make a
table of distinct n-grams.  A bit set of fixed size over four words of each n-gram lets the
scan of the texts, an array expression, name the few places where one may stand; only these
leave the row and meet the n-gram table in a join on the whole n-gram, which decides.  The table
is broadcast while it has at most ``broadcast_grams`` rows and joined by a shuffle beyond.

Nulls: a null text has no words.  A null item_id is an item of its own, written as an empty
string.  Items of one id are one item.  Repeated document rows each get their own result.
Without items or documents the result is what the counts then are: zeros, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowsets import split
from .spans import merged
from .skew import looked_up
from .staging import numbered, scratch, staged, texts_of
from .textops import ALNUM_WORD, folded

WINDOW = 10
BROADCAST_GRAMS = 200_000
MOST_BITS = 1 << 24  # 2 MB; 64 bits for each of up to 262,144 windows
NO_ITEMS = "array<string>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(ALNUM_WORD), F.lit(0))


def _signature(w: Column, at: Column, length: int) -> Column:
    """Hash of four words of the window of that length which begins at `at`."""
    places = sorted({0, (length - 1) // 3, 2 * (length - 1) // 3, length - 1})
    return F.xxhash64(*[F.get(w, at + p) for p in places], F.lit(length))


def _gram(w: Column, at: Column, length: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, at + p) for p in range(length)])


def _starts(w: Column, length: int) -> Column:
    return F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """length, gram, sig and item of all windows of the items (item_id, text)."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    out = None
    for length in range(1, window + 1):
        own = split.where(F.size("w") == length) if length < window else split.where(F.size("w") >= window)
        w = F.col("w")
        rows = own.select("item", F.explode(F.transform(_starts(w, length), lambda i: F.struct(_gram(w, i, length).alias("gram"), _signature(w, i, length).alias("sig")))).alias("g"))  # noqa: B023
        rows = rows.select(F.lit(length).alias("length"), "g.gram", "g.sig", "item")
        out = rows if out is None else out.union(rows)
    return out


def _bit_set(sigs: DataFrame, bits: int) -> list[int]:
    """Words of a set of `bits` bits, which holds the signatures modulo its size."""
    held = sigs.select(F.pmod("sig", F.lit(bits)).alias("b"))
    rows = held.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("word")).collect()
    out = [0] * (bits // 64)
    for r in rows:
        out[r["at"]] = r["word"]
    return out


def candidates(docs: DataFrame, lengths: list[int], bit_words: list[int]) -> DataFrame:
    """uid, doc_id, n_words and the places (at, length, gram) whose signature is in the bit set."""
    bits = 64 * len(bit_words)
    held = F.split(F.lit(",".join(map(str, bit_words))), ",").cast("array<bigint>")
    w = F.col("w")
    base = docs.select("uid", "doc_id", words(F.col("text")).alias("w"))

    found = None
    for length in lengths:
        signatures = F.transform(_starts(w, length), lambda i: F.pmod(_signature(w, i, length), F.lit(bits)))  # noqa: B023
        at = F.array_compact(
            F.transform(
                signatures,
                lambda b, i: F.when(F.get(held, F.shiftright(b, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0, i),
            )
        )
        rows = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), _gram(w, i, length).alias("gram")))  # noqa: B023
        found = rows if found is None else F.concat(found, rows)
    if found is None:
        found = F.array().cast("array<struct<at:int,length:int,gram:string>>")
    return base.select("uid", "doc_id", F.size("w").cast("long").alias("n_words"), found.alias("places"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_grams: int = BROADCAST_GRAMS) -> tuple[DataFrame, DataFrame]:
    """For every row of docs (uid, doc_id, text): uid, doc_id, n_words, spans (disjoint [lo, hi) of hit words) and found, the number of a set of items; and the sets: found, items (sorted ids).

    Documents with the same windows share a set, so a window that many items and many documents hold costs
    their sum, not their product."""
    windows = staged(item_windows(items, window), "windows")
    grams = staged(windows.groupBy("length", "gram").agg(F.count(F.lit(1)).alias("c")).select("length", "gram", F.monotonically_increasing_id().alias("g")), "grams")
    size = grams.count()
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most `window` rows
    bits = 1 << 14
    while bits < min(64 * size, MOST_BITS):
        bits *= 2
    places = staged(candidates(docs, lengths, _bit_set(windows, bits)), "places")
    some = places.where("size(places) > 0").select("uid", F.explode("places").alias("p")).select("uid", "p.*")
    if size <= broadcast_grams:
        met = some.join(F.broadcast(grams), ["length", "gram"])
    else:
        met = looked_up(staged(some, "some"), grams, ["length", "gram"]).where("g is not null")
    met = staged(met.select("uid", F.col("at").alias("lo"), (F.col("at") + F.col("length")).alias("hi"), "g"), "met")
    spans = merged(met.select("uid", "lo", "hi"), ["uid"]).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    own = met.groupBy("uid").agg(F.array_sort(F.collect_set("g")).alias("gs"))
    own = staged(own.select("uid", "gs", F.sha2(F.array_join(F.col("gs").cast("array<string>"), ","), 256).alias("found")), "sets")
    distinct = own.groupBy("found").agg(F.first("gs").alias("gs")).select("found", F.explode("gs").alias("g"))
    of = windows.join(grams, ["length", "gram"]).select("g", "item").distinct()
    sets = distinct.join(of, "g").groupBy("found").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_doc = spans.join(own.select("uid", "found"), "uid")
    return places.select("uid", "doc_id", "n_words").join(by_doc, "uid", "left"), staged(sets, "items")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")  # read once, and written with its places
    found, sets = hits(texts, items, window, broadcast_grams)
    digests = sets.select("found", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo)"), F.lit(0).cast("long"))
    some = looked_up(staged(found.where("found is not null").select("doc_id", "n_words", n_hit.alias("n_hit"), "found"), "hit"), digests, "found")
    rest = found.where("found is null").select("doc_id", "n_words", n_hit.alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"))
    return some.select(rest.columns).union(rest).withColumn("contaminated", F.col("n_hit") > 0)


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs with hit words and what follows them up to the next word cut from `text`; rows that lose all words go, rows that had none stay."""
    every = numbered(docs)
    with scratch(docs.sparkSession) as kept:
        spans = hits(texts_of(every), items, window, broadcast_grams)[0].where("spans is not null")
        found = staged(spans.select("uid", "spans", "n_words"), "spans")
        kept.append(found)
    # only texts with hits are shuffled
    some, rest = split(every, found.select("uid"), "uid")
    rows = some.join(found, "uid")
    separator, word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    # a word with what follows it; no expression over the whole text may stand inside the filter
    units = F.regexp_extract_all(F.col("row.text"), F.lit(f"{word}+{separator}*"), F.lit(0))
    ahead = F.regexp_extract("row.text", f"^{separator}*", 0)
    clean = F.concat(ahead, F.array_join(F.expr("filter(words, (w, j) -> not exists(spans, s -> j >= s.lo and j < s.hi))"), ""))
    cut = rows.where("aggregate(spans, 0, (s, x) -> s + x.hi - x.lo) < n_words").withColumn("words", units)
    return cut.select(F.col("row").withField("text", clean).alias("row")).select("row.*").union(rest.select("row.*"))
