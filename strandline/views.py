"""Domain views over the driver's tables, and the same views as SQL for DuckDB.

frames   one row per frame of a stream: clip_id, frame_idx, ptype (I, P, B), luma
mvs      motion records of a frame: frame_id, mv_idx, source, w, h, dst_x, dst_y, motion_x, motion_y, motion_scale
tiles    8x8 tiles as rows: scene, frame_idx, pos (y*8+x), luma
packets  two timed streams: stream, rank, t (microseconds from the stream's start), id
scores   measured cells: win, degrade, model, metric
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID_W, GRID_H = 64, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "clip_id")
    order = Window.partitionBy("clip_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "purchase", "I").when(F.col("event_type").isin("click", "view"), "P").otherwise("B")
    return events.select(
        "clip_id", (F.row_number().over(order) - 1).alias("frame_idx"), kind.alias("ptype"), F.col("value").alias("luma")
    )


def mvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # numbered by its own frame_id, so that steps by frame find the records dealt
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "frame_id")
    order = Window.partitionBy("frame_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    block = F.when(F.col("l_linestatus") == "F", 16).otherwise(8)
    return li.select(
        "frame_id",
        (F.row_number().over(order) - 1).alias("mv_idx"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("source"),
        block.alias("w"),
        block.alias("h"),
        (F.col("l_partkey") % GRID_W).cast("int").alias("dst_x"),
        (F.col("l_suppkey") % GRID_H).cast("int").alias("dst_y"),
        (F.col("l_quantity") - 25).cast("int").alias("motion_x"),
        (F.col("l_linenumber") - 4).cast("int").alias("motion_y"),
        F.lit(4).alias("motion_scale"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").alias("scene"), F.col("vec_id").alias("frame_idx"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("scene", "frame_idx", "pos", F.least(F.greatest(F.col("v").cast("double") * 255 + 128, F.lit(0.0)), F.lit(255.0)).alias("luma"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def timed(name: str, stream: str, rank: int, ts: str, ident: str) -> DataFrame:
        own = table(spark, sf_dir, name).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(ident).alias("id"))
        start = own.agg(F.min("us").alias("start"))
        return own.join(F.broadcast(start)).select(F.lit(stream).alias("stream"), F.lit(rank).alias("rank"), (F.col("us") - F.col("start")).alias("t"), "id")

    return timed("events", "video", 0, "ts", "event_id").unionByName(timed("orders", "audio", 1, "o_orderdate", "o_orderkey"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("lang").alias("win"), F.col("source").alias("degrade"), F.col("quality").alias("model"), F.col("n_chars").cast("double").alias("metric"), "doc_id"
    )


#: The same views in DuckDB, as common table expressions.
FRAMES = """frames AS (
  SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
    CASE WHEN event_type = 'purchase' THEN 'I' WHEN event_type IN ('click', 'view') THEN 'P' ELSE 'B' END AS ptype, value AS luma
  FROM events)"""
MVS = """mvs AS (
  SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS mv_idx,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS source, CASE WHEN l_linestatus = 'F' THEN 16 ELSE 8 END AS w, CASE WHEN l_linestatus = 'F' THEN 16 ELSE 8 END AS h,
    CAST(l_partkey % 64 AS INTEGER) AS dst_x, CAST(l_suppkey % 32 AS INTEGER) AS dst_y,
    CAST(trunc(l_quantity - 25) AS INTEGER) AS motion_x, CAST(l_linenumber - 4 AS INTEGER) AS motion_y, 4 AS motion_scale
  FROM lineitem)"""
TILES = """tiles AS (
  SELECT label AS scene, vec_id AS frame_idx, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
    least(greatest(CAST(unnest(embedding) AS DOUBLE) * 255 + 128, 0), 255) AS luma
  FROM embeddings)"""
PACKETS = """packets AS (
  SELECT 'video' AS stream, 0 AS rank, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS t, event_id AS id FROM events
  UNION ALL
  SELECT 'audio', 1, epoch_us(o_orderdate) - (SELECT min(epoch_us(o_orderdate)) FROM orders), o_orderkey FROM orders)"""
SCORES = """scores AS (
  SELECT lang AS win, source AS degrade, quality AS model, CAST(n_chars AS DOUBLE) AS metric, doc_id FROM documents JOIN labels USING (doc_id))"""
