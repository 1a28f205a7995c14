"""The batch entry: window, cuts, signals, routing, plates, reconstruction, sound, output, check, statistics."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flow, kernels
from ..operators import motion as motions
from ..operators import routing, segment, selection, tiles
from ..shared import shared_path
from ..sources import readers, sinks
from .recon import PICTURES, planes, reconstructed, small_motion, with_neighbours

MODES = ("auto", "instant", "quality", "layered")
SAMPLES = 12  # frames of a scene that are looked at for a hidden cut


def _once(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signals(cut: DataFrame, motion: DataFrame, places: DataFrame | None, plate: DataFrame | None, side: int) -> DataFrame:
    """What the router asks of each scene (fb_mean, mag_median, n_scenes, hidden_cut, verdict, coverage, plate_resid).

    cut: scene, frame_idx, luma, is_cut; motion: frame_idx, mvs; places: scene, frame_idx, pos, luma, alpha of scenes with
    mattes and plate: scene, pos, value, or neither.  A scene without motion records has no holes and an unknown camera."""
    records = cut.select("scene", "frame_idx").join(motion, "frame_idx").select("scene", F.col("frame_idx").alias("frame_id"), F.explode("mvs").alias("m")).select("scene", "frame_id", "m.*")
    sums = motions.motion_signal(motions.direction(records, "past"), side, side)
    still = records.select("scene", F.col("frame_id")).distinct().join(sums, "frame_id")
    moved = still.groupBy("scene").agg((100.0 * F.avg("intra")).alias("fb_mean"), F.median("mag_mean").alias("mag_median"))
    camera = motions.camera_verdict(records, F.col("scene")).select(F.col("clip").alias("scene"), "verdict")
    seen = selection.k_samples(cut, SAMPLES, key="scene").withColumn("size", F.lit(side))
    hidden = selection.hidden_cut(seen, "luma", "size", key="scene").select("scene", F.col("suspected").alias("hidden_cut"))
    own = cut.groupBy("scene").agg((F.count_if("is_cut") + 1).cast("int").alias("n_scenes")).join(moved, "scene", "left").join(camera, "scene", "left").join(hidden, "scene", "left")
    if places is not None:
        covered = places.groupBy("scene").agg(F.avg((F.col("alpha") >= 0.5).cast("double")).alias("coverage"))
        ground = places.where("alpha < 0.5").join(plate, ["scene", "pos"]).groupBy("scene").agg(F.avg(F.abs(F.col("luma") - F.col("value"))).alias("plate_resid"))
        own = own.join(covered, "scene", "left").join(ground, "scene", "left")
    else:
        own = own.withColumn("coverage", F.lit(None).cast("double")).withColumn("plate_resid", F.lit(None).cast("double"))
    filled = {"fb_mean": F.lit(0.0), "mag_median": F.lit(0.0), "hidden_cut": F.lit(False), "verdict": F.lit("UNKNOWN")}
    return own.withColumns({c: F.coalesce(c, v) for c, v in filled.items()})


def routed(told: DataFrame, mode: str = "auto") -> DataFrame:
    """scene, mode and reason: the mode that was asked for, or the one that the scene's signals call for."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode != "auto":
        return told.select("scene", F.lit(mode).alias("mode"), F.lit("asked for").alias("reason"))
    return routing.recommended_mode(told).select("scene", "mode", "reason")


def over_plates(places: DataFrame, plate: DataFrame, side: int) -> DataFrame:
    """scene, frame_idx, plane and layered: each frame's subject over its scene's plate, or the frame itself where its ground doesn't fit the plate."""
    ground = places.where("alpha < 0.5").join(plate.select("scene", "pos", "value"), ["scene", "pos"])
    d = F.col("luma") - F.col("value")
    fit = ground.groupBy("scene", "frame_idx").agg(tiles.psnr_of(F.avg(d * d)).alias("psnr"))
    every = places.select("scene", "frame_idx").distinct().join(fit, ["scene", "frame_idx"], "left")
    guard = routing.guarded(every, ["scene"], "frame_idx", "psnr").select("scene", "frame_idx", "bad")
    laid = tiles.layered(places, plate.select("scene", "pos", "plate"), guard)
    joined = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("v")))), lambda x: x["v"])
    return laid.groupBy("scene", "frame_idx").agg(joined.alias("laid"), F.max("layered").alias("layered"))  # side * side places a frame


def process(frames: DataFrame, motion: DataFrame, out: str, mode: str = "auto", start: int = 0, most: int | None = None, soft_cap: int = 12, side: int = 8, scale: int = 2, occlusion: str = "reactive", mattes: DataFrame | None = None, audio: DataFrame | None = None, fps: float = 25.0) -> DataFrame:
    """Reconstructs the frames of each scene at a larger size into the table `out` (a folder a scene) and returns a row a scene.

    frames: scene, frame_idx, ptype, plane; motion: frame_idx, mvs; mattes: scene, frame_idx, alpha (a plane); audio: scene, t
    seconds, id.  A chunk is a task's unit, at most about soft_cap frames.  A layered scene shows its subject over one
    plate, every frame upscaled alone; without mattes none is layered.  Sound ends with the picture and is written
    beside it, to `out`-sound.  The result: mode, reason, n_frames, cuts, chunks, anchors, layered (frames), hole_frac, psnr, packets, and
    whether frames are as many and as large as they should be and sound ends within half a second of them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "layered" and mattes is None:
        raise ValueError("layered needs mattes")
    spark = frames.sparkSession
    line = readers.frame_window(frames, start, most).select("scene", "frame_idx", "ptype", "plane")
    mean = F.aggregate("plane", F.lit(0.0), lambda s, v: s + v, lambda s: s / (side * side))
    lines = line.select(F.col("scene").alias("clip_id"), "frame_idx", "ptype", mean.alias("luma"))
    cut = _once(segment.gop_chunks(segment.scene_cuts(lines), soft_cap).withColumnRenamed("clip_id", "scene"), "cuts")
    places = plate = None
    if mattes is not None:
        both = line.join(mattes.select("scene", "frame_idx", "alpha"), ["scene", "frame_idx"])
        places = _once(both.select("scene", "frame_idx", F.posexplode(F.arrays_zip("plane", "alpha")).alias("pos", "v")).select("scene", "frame_idx", "pos", F.col("v.plane").alias("luma"), F.col("v.alpha").alias("alpha")), "places")
        plate = _once(tiles.plate_median(places, F.col("alpha") < 0.5, 3), "plate")
    modes = _once(routed(signals(cut, motion, places, plate, side), mode), "modes")
    work = F.when(F.col("mode") == "layered", "quality").otherwise(F.col("mode"))
    chunks = cut.select("scene", "frame_idx", "chunk_id").join(modes.select("scene", work.alias("mode"), (F.col("mode") == "layered").alias("lay")), "scene")
    own = line.join(chunks, ["scene", "frame_idx"]).join(motion, "frame_idx", "left")
    laid = None
    if places is not None:
        laid = over_plates(places.join(modes.where("mode = 'layered'").select("scene"), "scene", "left_semi"), plate, side)
        own = own.join(laid, ["scene", "frame_idx"], "left").withColumn("plane", F.coalesce("laid", "plane")).drop("laid", "layered")
    sinks.frames_out(own.groupBy("scene", "chunk_id").applyInPandas(reconstructed(side, scale, occlusion, pictures=True), PICTURES), out)
    done = spark.read.schema(PICTURES).parquet(out)
    stats = done.groupBy("scene").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_distinct("chunk_id").alias("chunks"), F.count_if("is_anchor").alias("anchors"), F.avg("hole_frac").alias("hole_frac"), F.avg("psnr").alias("psnr"),
        F.count_if(F.size("picture") != (side * scale) ** 2).alias("odd"),
    )
    want = cut.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_cut").alias("cuts"))
    both = want.join(stats, "scene", "left").join(modes, "scene")
    count = laid.groupBy("scene").agg(F.count_if("layered").alias("layered")) if laid is not None else modes.select("scene", F.lit(0).cast("long").alias("layered"))
    both = both.join(count, "scene", "left").withColumn("layered", F.coalesce("layered", F.lit(0)))
    if audio is not None:
        sound = audio.join(want.select("scene", "n"), "scene").where(F.col("t") < F.col("n") / fps).drop("n")
        sound.repartition("scene").sortWithinPartitions("scene", "t").write.partitionBy("scene").parquet(f"{out}-sound")
        kept = spark.read.schema(sound.schema).parquet(f"{out}-sound").groupBy("scene").agg(F.count(F.lit(1)).alias("packets"), F.max("t").alias("last"))
        both = both.join(kept, "scene", "left")
    else:
        both = both.withColumn("packets", F.lit(0).cast("long")).withColumn("last", F.lit(None).cast("double"))
    sync = F.coalesce(F.abs(F.col("last") - F.col("n_frames") / fps) <= 0.5, F.lit(True))
    return both.select(
        "scene", "mode", "reason", "n_frames", "cuts", "chunks", "anchors", "layered", "hole_frac", "psnr", F.coalesce("packets", F.lit(0)).alias("packets"),
        (F.col("n_frames") == F.col("n")).alias("count_ok"), (F.col("odd") == 0).alias("size_ok"), sync.alias("sync_ok"),
    )


def flicker(done: DataFrame, frames: DataFrame, side: int, scale: int) -> DataFrame:
    """scene, frame_idx and tof of finished frames (scene, frame_idx, picture): the error of their motion since the frame before against that of
    the frames (plane) upscaled alone."""
    own = done.select("scene", "frame_idx", "picture").join(frames.select("scene", "frame_idx", "plane"), ["scene", "frame_idx"])
    both = with_neighbours(own.select("scene", "frame_idx", F.struct("picture", "plane").alias("plane")), ["before"])

    def run(batches):
        size = side * scale
        for rows in batches:
            made = [np.stack([np.asarray(v["picture"], float).reshape(size, size) for v in rows[c]]) if len(rows) else np.zeros((0, size, size)) for c in ("before", "plane")]
            true = [np.stack([kernels.resized(np.asarray(v["plane"], float).reshape(side, side), size, size) for v in rows[c]]) if len(rows) else np.zeros((0, size, size)) for c in ("before", "plane")]
            yield pd.DataFrame({"scene": rows["scene"], "frame_idx": rows["frame_idx"], "tof": flow.motion_error(*made, *true)})

    return both.mapInPandas(run, "scene int, frame_idx long, tof double")


def compared(frames: DataFrame, motion: DataFrame, conditions: Sequence[tuple[str, str]], out: str, side: int = 8, scale: int = 2, **options) -> DataFrame:
    """mode, occlusion, scene and the metrics of each condition (mode, way of finding occlusions); frames go below `out`, a folder a condition."""
    spark, rows = frames.sparkSession, None
    for mode, occlusion in conditions:
        path = f"{out}/{mode}-{occlusion}"
        told = process(frames, motion, path, mode=mode, occlusion=occlusion, side=side, scale=scale, **options)
        done = spark.read.schema(PICTURES).parquet(path)
        steady = flicker(done, frames, side, scale).groupBy("scene").agg(F.avg("tof").alias("tof"))
        own = told.join(steady, "scene", "left").select(F.lit(mode).alias("asked"), F.lit(occlusion).alias("occlusion"), *told.columns, "tof")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def process_clips(spark: SparkSession, d: str) -> DataFrame:
    """Every scene of the tiles through the batch entry, with round mattes that move, and sound."""
    frames = planes(spark, d).select("scene", "frame_idx", "ptype", "plane")
    x, y = "(k % 8 - 3.5 - frame_idx % 3)", "(floor(k / 8) - 3.5)"
    alpha = F.expr(f"transform(sequence(0, 63), k -> if({x} * {x} + {y} * {y} < 6.0, 1.0D, 0.0D))")
    mattes = frames.select("scene", "frame_idx", alpha.alias("alpha"))
    audio = frames.select("scene", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "frame_idx").select("scene", (F.col("frame_idx") % 64 / 25.0 + F.col("k") / 250.0).alias("t"), (F.col("frame_idx") * 10 + F.col("k")).alias("id"))
    return process(frames, small_motion(spark, d), shared_path(spark, "clips"), mattes=mattes, audio=audio)


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs the batch entry over the tiles of a folder of tables and writes a line of metrics for each scene and condition as CSV."""
    say = argparse.ArgumentParser(description=main.__doc__)
    say.add_argument("tables", help="folder of the tables")
    say.add_argument("out", help="folder for frames and metrics")
    say.add_argument("--mode", action="append", choices=MODES[:3], help="may be repeated; auto if absent")
    say.add_argument("--occlusion", action="append", choices=("none", "reactive", "adaptive", "full"), help="may be repeated; reactive if absent")
    say.add_argument("--start", type=int, default=0)
    say.add_argument("--frames", type=int, help="at most so many of a scene's frame numbers")
    say.add_argument("--soft-cap", type=int, default=12)
    got = say.parse_args(arguments)
    if spark is None:
        from ..session import session

        spark = session()
    frames = planes(spark, got.tables).select("scene", "frame_idx", "ptype", "plane")
    conditions = [(m, o) for m in got.mode or ["auto"] for o in got.occlusion or ["reactive"]]
    rows = compared(frames, small_motion(spark, got.tables), conditions, f"{got.out}/frames", start=got.start, most=got.frames, soft_cap=got.soft_cap)
    sinks.metrics_csv(rows.orderBy("asked", "occlusion", "scene"), f"{got.out}/metrics")


QUERIES = {"process_clips": process_clips}
ORACLE_SQL: dict[str, str] = {}

if __name__ == "__main__":
    main()
