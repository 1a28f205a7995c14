"""Writers and checks of what was written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import shared_path


def metrics_csv(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV with a header; nulls are empty fields."""
    rows.write.mode("overwrite").option("nullValue", "").option("emptyValue", "").csv(path, header=True)


def memoised(spark: SparkSession, path: str, make: Callable[[], DataFrame], schema: str | None = None, n: int | None = None) -> DataFrame:
    """The table at path; made and written first where it is missing, or is not of the schema or the number of rows that it should have."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(conf).exists(p):
        held = spark.read.parquet(path)
        kinds = lambda fields: [(f.name, f.dataType.simpleString()) for f in fields]
        if (schema is None or kinds(held.schema) == kinds(T._parse_datatype_string(schema))) and (n is None or held.count() == n):
            return held
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def verified(frames: DataFrame, packets: DataFrame, expected: DataFrame) -> DataFrame:
    """Per clip: the frame number is as expected, frames have one size, and sound ends within half a second of the picture.

    frames: clip, frame_idx, w, h, fps; packets: clip, t seconds (sound); expected: clip, n.
    """
    f = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("w", "h").alias("sizes"), F.max("fps").alias("fps"))
    a = packets.groupBy("clip").agg(F.max("t").alias("sound_end"))
    out = expected.join(f, "clip", "left").join(a, "clip", "left")
    video_end = F.try_divide("n_frames", "fps")
    gap = F.abs(F.col("sound_end") - video_end)
    return out.select("clip", (F.col("n_frames") == F.col("n")).alias("count_ok"), (F.col("sizes") == 1).alias("size_ok"), F.coalesce(gap <= 0.5, F.lit(True)).alias("sync_ok"))


def mux_order(video: DataFrame, audio: DataFrame, n_frames: int, fps: float) -> DataFrame:
    """Packets (t seconds) of both streams in time order, picture first on ties, sound cut at the picture's end."""
    kept = audio.where(F.col("t") < n_frames / fps)
    return video.withColumn("rank", F.lit(0)).unionByName(kept.withColumn("rank", F.lit(1))).orderBy("t", "rank")


def with_trailing_copy(frames: DataFrame, key: str = "clip_id") -> DataFrame:
    """Every frame and, at a clip's end, its last one again, for a doubled frame rate; left: the frame before across chunk borders."""
    order = Window.partitionBy(key).orderBy("frame_idx")
    own = frames.withColumn("left", F.lag("frame_idx").over(order)).withColumn("__last", F.lead("frame_idx").over(order).isNull())
    copy = own.where("__last").withColumn("left", F.col("frame_idx")).withColumn("frame_idx", F.col("frame_idx") + 1)
    return own.unionByName(copy).drop("__last")


@contextmanager
def spilled(plates: DataFrame, name: str = "plates", key: str = "scene") -> Iterator[DataFrame]:
    """Plates written once, a folder a scene, and read back inside the block; the files go at its end, also after an error."""
    spark, path = plates.sparkSession, shared_path(plates.sparkSession, name)
    try:
        plates.repartition(key).write.partitionBy(key).parquet(path)
        yield spark.read.schema(plates.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def export_chunk(frames: DataFrame, flow: DataFrame, path: str, size: int = 16, key: str = "clip_id") -> None:
    """The first `size` frames of each clip, a folder a clip: planes and dense vectors by cell; a cell without one is absent, not marked.

    frames: key, frame_idx and planes; flow: key, frame_idx, y, x, dx, dy."""
    own = frames.where(F.col("frame_idx") < size)
    own.repartition(key).sortWithinPartitions("frame_idx").write.partitionBy(key).parquet(f"{path}/frames")
    flow.join(own.select(key, "frame_idx"), [key, "frame_idx"], "left_semi").repartition(key).sortWithinPartitions("frame_idx", "y", "x").write.partitionBy(key).parquet(f"{path}/flow")


def frames_out(frames: DataFrame, path: str, key: str = "scene") -> None:
    """Finished frames in display order, a folder a clip."""
    frames.repartition(key, F.floor(F.col("frame_idx") / 4096)).sortWithinPartitions(key, "frame_idx").write.partitionBy(key).parquet(path)
