"""Online cut detector and chunker over a stream of frames.

State is a few numbers per clip in the RocksDB store, a row for PACK clips of neighbouring numbers.  A micro-batch may hold frames of a clip in
any order, so they are sorted there; batches must come in display order, as a decoder gives them.
Clips are short in a batch and many, and each call and each question to the store is a round trip, so a call
serves a pack of clips: its state is read once and written once.  A pack's state does not grow with the number of clips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.segment import CutRules, CutState, cut_step
from ..shared import shared_path

PACK_BITS = 8  # a pack holds 256 clips
STATE = "clip array<long>, luma array<double>, base array<double>, chroma_base array<double>, last array<int>, chunk array<int>, held array<int>"
OUT = "clip_id long, frame_idx int, ptype string, luma double, diff double, is_cut boolean, chunk_id int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


ROW = Row(*(c.split()[0] for c in OUT.split(", ")))


def level(luma: float | None) -> float:
    """A frame without luma has no difference to others: NaN, which fires no rule."""
    return float("nan") if luma is None else luma


def told(value: float | None) -> float | None:
    return None if value is None or value != value else value


def by_clip(rows: Iterator[Row], value: Callable) -> dict:
    """value(row) of the rows of each clip, in the order in which they come."""
    out: dict = {}
    for r in rows:
        out.setdefault(r.clip_id, []).append(value(r))
    return out


def packed(frames: DataFrame):
    """frames grouped by pack."""
    return frames.withColumn("__pack", F.shiftright("clip_id", PACK_BITS)).groupBy("__pack")


class CutProcessor(StatefulProcessor):
    """Cuts and chunk numbers of the frames of a pack of clips."""

    def __init__(self, rules: CutRules = CutRules(), soft_cap: int = 48):
        self.rules, self.soft_cap = rules, soft_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("clip", STATE)
        self.step = cut_step(self.rules)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.held.get()
        clips = {} if held is None else {c: own for c, *own in zip(*held, strict=True)}
        out = []
        for clip, frames in by_clip(rows, lambda r: (r.frame_idx, r.ptype, level(r.luma))).items():
            s, chunk, n = CutState(), 0, 0
            if clip in clips:
                s.luma, s.base, s.chroma_base, s.last, chunk, n = clips[clip]
            for idx, kind, luma in sorted(frames, key=lambda f: f[0]):
                diff, cut, _ = self.step(s, idx, kind, luma, None)
                if n and (kind == "I" or cut or (n >= self.soft_cap and kind == "P")):
                    chunk, n = chunk + 1, 0
                n += 1
                out.append(ROW(clip, idx, kind, told(luma), told(diff), cut, chunk))
            clips[clip] = s.luma, s.base, s.chroma_base, s.last, chunk, n
        self.held.update(tuple(list(v) for v in zip(*((c, *own) for c, own in clips.items()), strict=True)))
        return iter(out)

    def close(self) -> None:
        pass


def online_cuts(frames: DataFrame, rules: CutRules = CutRules(), soft_cap: int = 48) -> DataFrame:
    """A streaming DataFrame of frames (clip_id, frame_idx, ptype, luma) with diff, is_cut and chunk_id."""
    return packed(frames).transformWithState(CutProcessor(rules, soft_cap), OUT, "append", "none")


def run_to_end(spark: SparkSession, stream: DataFrame, out: str) -> None:
    """Runs a stream over what its source has now into the table `out`; a later call goes on from there."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def in_batches(spark: SparkSession, rows: DataFrame, part: Column, parts: int, operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a streaming operator makes of rows that arrive in `parts` batches, in order of `part` (0 to parts - 1).

    One pass writes all batches, each as many files as there are tasks; a batch's folder is then moved
    under the stream's source, by name, and the stream runs over it.  Batches without rows are left out.
    """
    base, out = shared_path(spark, f"{name}-in"), shared_path(spark, name)
    rows.withColumn("__part", part.cast("int")).write.partitionBy("__part").parquet(f"{base}/waiting")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/live"))
    stream = None
    for k in range(parts):
        if not fs.exists(path(f"{base}/waiting/__part={k}")):
            continue
        fs.rename(path(f"{base}/waiting/__part={k}"), path(f"{base}/live/{k}"))
        stream = operator(spark.readStream.schema(rows.schema).parquet(f"{base}/live/*"))
        run_to_end(spark, stream, out)
    if stream is None:
        return spark.createDataFrame([], operator(rows).schema)
    return spark.read.schema(stream.schema).parquet(out)


def windowed_rates(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by type in windows of event time; ts may lack a zone, which a watermark needs."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
