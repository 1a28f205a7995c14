"""The clip source as a stream: same frames as in a batch, admission, and a stop in the middle."""

import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.sources import readers

OPTIONS = {"frames": 50, "height": 18, "width": 24, "chunk": 4, "kind": "cut"}


@pytest.fixture(scope="module")
def clip(spark):
    spark.dataSource.register(readers.ClipSource)
    return spark


def run(spark, tmp_path, until=None, **options):
    stream = spark.readStream.format("clip").options(**OPTIONS, **options).load()
    seen = stream.select("frame_idx", "ptype", F.hash("plane").alias("h"))
    q = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
    end = time.monotonic() + 90
    sizes = lambda: [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    try:
        while time.monotonic() < end and (sum(sizes()) < 50 if until is None else len(sizes()) < until):
            assert not q.exception()
            time.sleep(0.1)
            if until is None and q.status["message"].startswith("Waiting") and spark.read.parquet(str(tmp_path / "out")).count() >= 50:
                break
    finally:
        q.stop()
    return sizes()


def test_a_stream_stopped_in_the_middle_loses_and_doubles_nothing(clip, tmp_path):
    limit = {"perBatch": 7, "progress": str(tmp_path / "progress")}
    first = run(clip, tmp_path, 2, **limit)
    assert first and max(first) <= 7
    got = clip.read.parquet(str(tmp_path / "out")).count()
    assert got < 50
    run(clip, tmp_path, **limit)
    rows = clip.read.parquet(str(tmp_path / "out")).orderBy("frame_idx").collect()
    want = clip.read.format("clip").options(**OPTIONS).load().select("frame_idx", "ptype", F.hash("plane").alias("h")).orderBy("frame_idx").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in want] and len(want) == 50


def test_frames_come_with_the_clock(tmp_path):
    own = readers._ClipStreamReader({"frames": "50", "fps": "10", "since": str(time.time() - 2)})
    assert 19 <= own.latestOffset()["frame"] <= 25 and own.initialOffset() == {"frame": 0}
    late = readers._ClipStreamReader({"frames": "50", "startFrame": "10", "maxFrames": "5"})
    assert late.latestOffset() == {"frame": 15} and [p.value for p in late.partitions({"frame": 10}, {"frame": 15})] == [(10, 15)]
    with pytest.raises(ValueError, match="progress"):
        readers._ClipStreamReader({"perBatch": "3"})


def test_a_crash_between_note_and_batch_is_made_up_for(tmp_path):
    options = {"frames": "50", "perBatch": "7", "progress": str(tmp_path / "p")}
    assert readers._ClipStreamReader(options).latestOffset() == {"frame": 7}
    again = readers._ClipStreamReader(options)  # Spark has no batch yet and starts at 0
    assert again.latestOffset() == {"frame": 14} and sum(b - a for a, b in (p.value for p in again.partitions({"frame": 0}, {"frame": 14}))) == 14


def test_motion_records_carry_the_canvas(clip):
    rows = clip.read.format("clip").options(frames=8, height=32, width=48, motion="true", kind="pan").load().orderBy("frame_idx").collect()
    assert rows[0].mvs == [] and len(rows[1].mvs) == 6
    import numpy as np

    planes = [np.array(r.plane).reshape(32, 48) for r in rows]
    for i in range(1, 8):
        records = np.array([[m.w, m.h, m.dst_x, m.dst_y, m.motion_x, m.motion_y, m.motion_scale] for m in rows[i].mvs])
        dx, dy = kernels.painted(records, 32, 48)
        off = np.abs(kernels.backward_warp(planes[i - 1], dx, dy) - planes[i])[:10, :-4]  # above the block
        assert off.max() < 1e-9
