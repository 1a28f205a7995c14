"""Scans."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Columns of exported motion records; framenum counts from 1, flags are hexadecimal text.
MV_CSV = "framenum int, source int, blockw int, blockh int, srcx int, srcy int, dstx int, dsty int, flags string, motion_x int, motion_y int, motion_scale int"
RESULT_MARK = "RESULT_JSON "
MOST_MODES = 100


def motion_csv(spark: SparkSession, path: str, clip: str) -> DataFrame:
    """Motion records of a clip from CSV with a header, frame numbers counted from 0, in file order by mv_idx."""
    rows = spark.read.schema(MV_CSV).csv(path, header=True)
    # ids grow along a split; splits are told apart by file and by where they start in it
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    own = rows.withColumn("__at", at).withColumn("mv_idx", F.row_number().over(Window.partitionBy("framenum").orderBy("__at")) - 1)
    return own.select(
        F.lit(clip).alias("clip"), (F.col("framenum") - 1).alias("frame_idx"), "mv_idx", "source", F.col("blockw").alias("w"), F.col("blockh").alias("h"),
        F.col("srcx").alias("src_x"), F.col("srcy").alias("src_y"), F.col("dstx").alias("dst_x"), F.col("dsty").alias("dst_y"),
        F.conv(F.regexp_replace("flags", "^0[xX]", ""), 16, 10).cast("bigint").alias("flags"), "motion_x", "motion_y", "motion_scale",
    )


def frame_window(frames: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """Frames [start, start + most) of each clip; a filter, so the scan is pruned by it."""
    own = frames.where(F.col("frame_idx") >= start)
    return own if most is None else own.where(F.col("frame_idx") < start + most)


def with_motion(frames: DataFrame, mvs: DataFrame, key: list[str]) -> DataFrame:
    """Each frame with its motion records in order as an array, null where it has none."""
    names = [c for c in mvs.columns if c not in key and c != "mv_idx"]
    held = mvs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("mv_idx", *names))).alias("mvs"))
    return frames.join(held, key, "left")


def result_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of the lines that begin with RESULT_JSON, other lines are skipped; a line that does not parse gives nulls."""
    lines = spark.read.text(path).where(F.col("value").startswith(RESULT_MARK))
    return lines.select(F.from_json(F.substring("value", len(RESULT_MARK) + 1, 1 << 30), schema).alias("r")).select("r.*")


def source_catalog(files: DataFrame, modes: DataFrame) -> DataFrame:
    """One row per name and mode: the file of the first folder that has it, with an estimated time.

    files: name, folder_rank, n_frames, fps; modes: mode, ms_frame, at most MOST_MODES rows, which are broadcast.
    """
    if modes.limit(MOST_MODES + 1).count() > MOST_MODES:
        raise ValueError(f"more than {MOST_MODES} modes")
    first = files.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("folder_rank"))).where("k = 1").drop("k")
    return first.crossJoin(F.broadcast(modes)).withColumn("seconds", F.bround(F.col("n_frames") * F.col("ms_frame") / 1000).cast("bigint")).withColumn("duration", F.try_divide("n_frames", "fps"))


def resolved(catalog: DataFrame, name: str) -> DataFrame:
    """The catalog rows of a base name; anything before the last slash is ignored, an unknown name is an error."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    found = catalog.where(F.col("name") == base)
    if not base or not found.limit(1).count():
        raise FileNotFoundError(name)
    return found


KINDS = ("pan", "fast", "graphics", "dark", "still", "cut", "odd")


def clip_frame(kind: str, i: int, n: int, h: int, w: int, scale: int = 1, speed: float = 1.5, seed: int = 7) -> np.ndarray:
    """Frame i of a made-up clip of n, [h * scale, w * scale]: a textured canvas that pans behind a faster block, and variants.

    fast: four times the speed; graphics: a title that stands still; dark: an eighth of the light, with noise;
    still: only the block moves; cut: another canvas from the middle on; odd: a size that no block divides.
    """
    from ..functions import kernels

    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "odd":
        h, w = h - 1, w - 3
    speed = 4 * speed if kind == "fast" else 0.0 if kind == "still" else speed
    rng = np.random.default_rng(seed + (1 if kind == "cut" and i >= n // 2 else 0))
    canvas = kernels.gaussian(rng.random((h * scale, w * scale + int(n * speed * scale) + 8)), 1.2) * 255
    x = int(round(i * speed * scale))
    out = canvas[:, x : x + w * scale].copy()
    at = int(i * 2 * max(speed, 1.0) * scale) % (w * scale)
    out[h * scale // 3 : 2 * h * scale // 3, at : at + h * scale // 3] = 230
    if kind == "graphics":
        out[: h * scale // 8, : w * scale // 2] = 255.0 * (np.arange(w * scale // 2) // 2 % 2)
    if kind == "dark":
        out = np.clip(out / 8 + np.random.default_rng([seed, i]).normal(0, 3, out.shape), 0, 255)
    return out


def synthetic_clip(spark: SparkSession, n: int = 24, h: int = 36, w: int = 64, scale: int = 3, speed: float = 1.5, seed: int = 7, kind: str = "pan") -> DataFrame:
    """frame_idx, ptype, plane (h*w) and truth (scaled) of a made-up clip; same for any partitioning."""
    from ..functions import kernels

    schema = "frame_idx int, ptype string, plane array<double>, truth array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in b.column("id").to_pylist():
                truth = clip_frame(kind, i, n, h, w, scale, speed, seed)
                plane = kernels.resized(truth, truth.shape[0] // scale, truth.shape[1] // scale, "area")
                out.append((i, "I" if i == 0 else "P", plane.ravel(), truth.ravel()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], ["frame_idx", "ptype", "plane", "truth"])

    return spark.range(n).mapInArrow(run, schema)


MOTION = "array<struct<source:int,w:int,h:int,dst_x:int,dst_y:int,motion_x:int,motion_y:int,motion_scale:int>>"


def clip_motion(kind: str, i: int, n: int, h: int, w: int, speed: float = 1.5, size: int = 16) -> list[tuple]:
    """Motion records of frame i of a made-up clip against the frame before, blocks of `size` over the panning canvas; none for the
    first frame and the one after a cut."""
    if i == 0 or (kind == "cut" and i == n // 2):
        return []
    if kind == "odd":
        h, w = h - 1, w - 3
    speed = 4 * speed if kind == "fast" else 0.0 if kind == "still" else speed
    step = int(round(i * speed)) - int(round((i - 1) * speed))
    return [(-1, size, size, x + size // 2, y + size // 2, 4 * step, 0, 4) for y in range(0, h, size) for x in range(0, w, size)]


class ClipSource(DataSource):
    """spark.read.format("clip"): frames [startFrame, startFrame + maxFrames) of a made-up clip, `chunk` frames a task.

    Options: kind, frames (of the clip), height, width, seed, startFrame, maxFrames, chunk, motion (true: with the
    motion records of each frame).  Frames outside the window are never made.

    spark.readStream.format("clip") gives the same frames as they come: fps frames a second from `since` (seconds of
    the clock) on, all at once where fps is 0, and at most perBatch of them in a batch.  The end of each batch stands in
    Spark's checkpoint; a stream that is started again goes on behind the last one.  perBatch needs `progress`, a folder
    that lasts as long as the checkpoint, since a source is not told where a stream stood.
    """

    @classmethod
    def name(cls) -> str:
        return "clip"

    def schema(self) -> str:
        return "frame_idx int, ptype string, plane array<double>" + (f", mvs {MOTION}" if self.options.get("motion", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _ClipReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ClipStreamReader(dict(self.options))


class _Clip:
    """Options of a clip, its window of frames, and the rows of a span of them."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        whole = lambda name, value: int(options.get(name, value))
        self.kind, self.n, self.h, self.w, self.seed = options.get("kind", "pan"), whole("frames", 24), whole("height", 36), whole("width", 64), whole("seed", 7)
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        start = min(max(whole("startframe", 0), 0), self.n)
        self.span, self.chunk = (start, min(self.n, start + whole("maxframes", self.n))), max(whole("chunk", 16), 1)
        self.motion = options.get("motion", "false").lower() == "true"
        self.fps, self.since, self.most, self.progress = float(options.get("fps", 0)), float(options.get("since", 0)), whole("perbatch", 0), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("perBatch needs a folder for progress")

    def spans(self, lo: int, hi: int) -> list[InputPartition]:
        return [InputPartition((s, min(s + self.chunk, hi))) for s in range(lo, hi, self.chunk)]

    def rows(self, lo: int, hi: int) -> Iterator[tuple]:
        for i in range(lo, hi):
            row = (i, "I" if i == 0 else "P", clip_frame(self.kind, i, self.n, self.h, self.w, seed=self.seed).ravel().tolist())
            yield (*row, clip_motion(self.kind, i, self.n, self.h, self.w)) if self.motion else row


class _ClipReader(_Clip, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.spans(*self.span) or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(*partition.value)


class _ClipStreamReader(_Clip, DataSourceStreamReader):
    """Offsets name the frame behind the last one of a batch."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.at = self.span[0]  # frames up to here have been admitted

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": self.span[0]}

    def _there(self) -> int:
        """Frames that exist now."""
        if self.fps <= 0:
            return self.span[1]
        return min(self.span[1], self.span[0] + max(int((time.time() - self.since) * self.fps), 0))

    def _noted(self, end: int | None = None) -> int:
        """The end of the frames admitted so far, by this run of the stream or an earlier one."""
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.progress)
        name = f"{path}/admitted.json"
        held = self.at
        if files.get_file_info(name).type != fs.FileType.NotFound:
            with files.open_input_stream(name) as f:
                held = max(held, json.loads(f.read())["frame"])
        if end is not None and end > held:
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{name}.new") as f:
                f.write(json.dumps({"frame": end}).encode())
            files.move(f"{name}.new", name)
            held = end
        return held

    def latestOffset(self) -> dict:  # noqa: N802
        there = self._there()
        if self.most:
            # noted before the batch is: after a crash in between, the next batch begins at Spark's own offset and is larger
            there = self._noted(min(there, self._noted() + self.most))
        self.at = max(self.at, there)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["frame"])
        return self.spans(start["frame"], end["frame"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.rows(*partition.value)
