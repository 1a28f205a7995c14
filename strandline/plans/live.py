"""Streaming queries, run over whole tables to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..shared import shared_path
from ..sources import fragments
from ..streaming import online, reorder
from .streams import CHUNKS, CUTS


def stream_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The online detector over frames that come in three batches, a third of each clip in each."""
    clip = Window.partitionBy("clip_id")
    f = views.frames(spark, d).withColumn("n", F.count(F.lit(1)).over(clip))
    third = F.floor(3 * F.col("frame_idx") / F.col("n"))
    rows = f.withColumn("third", third).select("clip_id", "frame_idx", "ptype", "luma", "third")
    out = online.in_batches(spark, rows, F.col("third"), 3, online.online_cuts, "cuts")
    return out.where("is_cut").select("clip_id", "frame_idx", "diff", "ptype")


def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and hour, over a stream that comes in three ranges of time; the last hours stay open."""
    events = views.table(spark, d, "events").select("ts", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us is not null")
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    third = F.floor(3 * (F.col("us") - F.lit(ends["lo"] or 0)) / F.lit((ends["hi"] or 0) - (ends["lo"] or 0) + 1))
    out = online.in_batches(spark, events, third, 3, lambda s: online.windowed_rates(s, "1 hour", "1 hour"), "rates")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def fragment_sink(spark: SparkSession, d: str) -> DataFrame:
    """Frames of all clips with sound of orders, written as fragments and read back: what each fragment holds."""
    video = views.frames(spark, d).select(F.col("clip_id").alias("clip"), "frame_idx", F.col("frame_idx").alias("id"))
    o = views.table(spark, d, "orders").where("o_custkey is not null and o_orderkey is not null")
    audio = o.select(F.col("o_custkey").alias("clip"), (F.col("o_orderkey") % 400 / 40.0).alias("t"), F.col("o_orderkey").alias("id"))
    path = shared_path(spark, "fragments")
    spark.dataSource.register(fragments.FragmentSink)
    fragments.dealt(fragments.laid_out(video, audio, 25.0)).write.format("fragments").option("path", path).mode("append").save()
    return fragments.read_fragments(spark, path).groupBy("clip", "fragment").agg(
        F.count_if(F.col("rank") == 0).alias("frames"), F.count_if(F.col("rank") == 1).alias("packets"), F.max(F.when(F.col("rank") == 1, F.col("t"))).alias("sound_to"), F.sum("id").alias("ids")
    )


def stream_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of frames that come out of order: each one up to two batches of eight early or late, by a hash; a clip plays for an hour."""
    clip = Window.partitionBy("clip_id")
    f = views.frames(spark, d).withColumn("n", F.count(F.lit(1)).over(clip))
    part = F.col("frame_idx") / F.col("n")
    ts = F.timestamp_micros((F.lit(1_700_000_000_000_000) + part * 3_600_000_000).cast("long"))
    moved = F.floor(8 * part) + F.pmod(F.xxhash64("clip_id", "frame_idx"), F.lit(3)) - 1
    rows = f.select("clip_id", F.col("frame_idx").cast("int").alias("frame_idx"), "ptype", "luma", ts.alias("ts"), F.least(F.greatest(moved, F.lit(0)), F.lit(7)).cast("int").alias("batch"))
    out = online.in_batches(spark, rows, F.col("batch"), 8, lambda s: reorder.ordered_chunks(s, soft_cap=12, wait_ms=1_800_000, idle_ms=36_000_000), "reordered")
    return out.where("not late").select("clip_id", "frame_idx", "chunk_id")


QUERIES = {"stream_reordered": stream_reordered, "stream_cuts": stream_cuts, "stream_rates": stream_rates, "fragment_sink": fragment_sink}

ORACLE_SQL = {
    "fragment_sink": f"""WITH {views.FRAMES},
v AS (SELECT clip_id, frame_idx + 1 AS place, 0 AS rank, NULL::DOUBLE AS t, CAST(frame_idx AS BIGINT) AS id FROM frames),
a AS (SELECT o_custkey AS clip_id, greatest(CAST(ceil((o_orderkey % 400 / 40.0::DOUBLE - 1.0) * 25.0) AS INTEGER), 1) AS place, 1 AS rank, o_orderkey % 400 / 40.0::DOUBLE AS t, o_orderkey AS id FROM orders),
b AS (SELECT * FROM v UNION ALL SELECT a.* FROM a JOIN (SELECT clip_id, max(place) AS last FROM v GROUP BY clip_id) e USING (clip_id) WHERE a.place <= e.last)
SELECT CAST(clip_id AS VARCHAR) AS clip, CAST((place - 1) // 12 AS INTEGER) AS fragment, count(*) FILTER (rank = 0) AS frames, count(*) FILTER (rank = 1) AS packets, max(t) AS sound_to, CAST(sum(id) AS BIGINT) AS ids
FROM b GROUP BY ALL""",
    "stream_reordered": CHUNKS.replace("SELECT clip_id, frame_idx, chunk_id, held - 1 AS place FROM c", "SELECT clip_id, frame_idx, chunk_id FROM c"),
    "stream_cuts": CUTS + "SELECT clip_id, frame_idx, diff, ptype FROM f WHERE is_cut",
    "stream_rates": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(hour AS TIMESTAMP) AS hour, event_type, n FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
