"""The batch entry, made-up clips, spilled plates, exports, and streams that are watched."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.plans import batch
from strandline.sources import readers, sinks
from strandline.streaming import progress


def clip(spark, scenes=3, n=30):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(scenes):
        base = rng.random((8, 8)) * 60
        for k in range(n):
            level = 40 if s == 0 and k < 26 else 120  # scene 0 has a cut
            rows.append((s, 100 * s + k, "I" if k == 0 else "P" if k % 3 == 0 else "B", (np.roll(base, k % 8, 1) + level).ravel().tolist()))
    return spark.createDataFrame(rows, "scene int, frame_idx long, ptype string, plane array<double>")


def test_process_writes_every_frame_and_tells_what_it_did(spark, tmp_path):
    frames = clip(spark)
    motion = spark.createDataFrame([], "frame_idx long, mvs array<struct<mv_idx:int,source:int,w:int,h:int,dst_x:int,dst_y:int,motion_x:int,motion_y:int,motion_scale:int>>")
    got = {r.scene: r for r in batch.process(frames, motion, str(tmp_path / "out")).collect()}
    assert [got[s].n_frames for s in range(3)] == [30] * 3 and all(r.count_ok and r.size_ok for r in got.values())
    assert [got[s].cuts for s in range(3)] == [1, 0, 0] and all(r.anchors <= r.n_frames for r in got.values())
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 90 and out.select(F.size("picture")).distinct().collect()[0][0] == 256
    every = {r.scene: r for r in batch.process(frames, motion, str(tmp_path / "best"), mode="quality", start=200, most=10).collect()}
    assert set(every) == {2} and every[2].anchors == every[2].n_frames == 10 and every[2].mode == "quality"
    first = spark.read.parquet(str(tmp_path / "best")).orderBy("frame_idx").first()
    plane = np.array(frames.where("frame_idx = 200").first()["plane"]).reshape(8, 8)
    assert (np.array(first["picture"]).reshape(16, 16) == kernels.levels(kernels.resized(plane, 16, 16))).all()
    with pytest.raises(ValueError):
        batch.process(frames, motion, str(tmp_path / "none"), mode="other")
    assert batch.process(frames.where("false"), motion, str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError, match="mattes"):
        batch.process(frames, motion, str(tmp_path / "none"), mode="layered")


def people(spark, n=40):
    """Scenes with a square that walks over a ground: 0 a ground that stays (one frame is lit up), 1 the same without anybody, 2 a ground that is never the same."""
    rng = np.random.default_rng(2)
    ground, rows, mattes = rng.random((8, 8)) * 60 + 60, [], []
    for s in range(3):
        for k in range(n):
            alpha = np.zeros((8, 8))
            if s != 1:
                alpha[2:6, k % 6 : k % 6 + 3] = 1
            plane = rng.random((8, 8)) * 200 if s == 2 else ground + (90 if s == 0 and k == 31 else 0)
            plane = np.where(alpha > 0, 230.0 if s != 2 else plane, plane)
            rows.append((s, 100 * s + k, "I" if k == 0 else "P", plane.ravel().tolist()))
            mattes.append((s, 100 * s + k, alpha.ravel().tolist()))
    frames = spark.createDataFrame(rows, "scene int, frame_idx long, ptype string, plane array<double>")
    return frames, spark.createDataFrame(mattes, "scene int, frame_idx long, alpha array<double>"), np.floor(ground)


MVS = "frame_idx long, mvs array<struct<mv_idx:int,source:int,w:int,h:int,dst_x:int,dst_y:int,motion_x:int,motion_y:int,motion_scale:int>>"


def test_auto_layers_a_person_over_one_plate(spark, tmp_path):
    frames, mattes, ground = people(spark)
    audio = spark.createDataFrame([(s, k / 10.0, k) for s in (0, 1) for k in range(40 if s == 0 else 10)], "scene int, t double, id long")
    none = spark.createDataFrame([], MVS)
    got = {r.scene: r for r in batch.process(frames, none, str(tmp_path / "out"), mattes=mattes, audio=audio).collect()}
    assert {s: (r.mode, r.reason) for s, r in got.items()} == {0: ("layered", "static person"), 1: ("instant", "no person in view"), 2: ("quality", "background not static")}
    assert (got[0].layered, got[0].anchors, got[1].layered) == (39, 40, 0)  # the frame that is lit up keeps its own ground
    assert (got[0].packets, got[0].sync_ok, got[1].packets, got[1].sync_ok, got[2].packets) == (16, True, 10, False, 0)
    shown = {r.frame_idx: np.array(r.picture).reshape(16, 16) for r in spark.read.parquet(str(tmp_path / "out")).where("scene = 0").collect()}
    plane = np.array(frames.where("frame_idx = 7").first()["plane"]).reshape(8, 8)
    alpha = np.array(mattes.where("frame_idx = 7").first()["alpha"]).reshape(8, 8)
    assert np.array_equal(shown[7], kernels.levels(kernels.resized(np.where(alpha > 0, plane, ground), 16, 16)))
    lit = np.array(frames.where("frame_idx = 31").first()["plane"]).reshape(8, 8)
    assert np.array_equal(shown[31], kernels.levels(kernels.resized(np.floor(lit), 16, 16)))
    assert {r.scene for r in spark.read.parquet(str(tmp_path / "out-sound")).collect()} == {0, 1}


def test_signals_of_motion_reach_the_router(spark, tmp_path):
    frames, mattes, _ = people(spark)
    block = lambda x, y, mx: (0, -1, 8, 8, x, y, mx, 0, 1)
    rows = [(100 * s + k, [block(4, 4, 20 if s == 0 else 1)]) for s in range(2) for k in range(1, 40)]
    rows += [(200 + k, [(0, -1, 2, 2, 1, 1, 0, 0, 1)]) for k in range(1, 40)]
    got = {r.scene: r.reason for r in batch.process(frames, spark.createDataFrame(rows, MVS), str(tmp_path / "out"), mattes=mattes).collect()}
    assert got == {0: "high motion or occlusion", 1: "layered unsafe", 2: "noise"}


def test_the_command_writes_metrics_of_each_condition(spark, tmp_path):
    from tests.test_oracles import SF

    batch.main([SF, str(tmp_path / "out"), "--mode", "instant", "--mode", "quality", "--occlusion", "none", "--frames", "60"], spark)
    rows = spark.read.csv(str(tmp_path / "out" / "metrics"), header=True, inferSchema=True).collect()
    assert {(r.asked, r.occlusion) for r in rows} == {("instant", "none"), ("quality", "none")} and len(rows) == 2 * len({r.scene for r in rows})
    tof = {m: {r.scene: r.tof for r in rows if r.asked == m} for m in ("instant", "quality")}
    assert all(r.count_ok and r.size_ok for r in rows) and np.mean(list(tof["quality"].values())) < np.mean(list(tof["instant"].values()))
    with pytest.raises(SystemExit):
        batch.main([SF, str(tmp_path / "x"), "--mode", "other"], spark)


def test_made_up_clips(spark):
    spark.dataSource.register(readers.ClipSource)
    for kind in readers.KINDS:
        rows = spark.read.format("clip").options(kind=kind, frames=20, startFrame=5, maxFrames=7, chunk=3, height=24, width=40).load().orderBy("frame_idx").collect()
        assert [r.frame_idx for r in rows] == list(range(5, 12))
        assert len(rows[0].plane) == (23 * 37 if kind == "odd" else 24 * 40)
        assert np.allclose(rows[2].plane, readers.clip_frame(kind, 7, 20, 24, 40).ravel())
    assert spark.read.format("clip").options(frames=10, startFrame=50).load().count() == 0
    mean = {k: [readers.clip_frame(k, i, 20, 24, 40).mean() for i in range(20)] for k in ("pan", "dark")}
    assert max(mean["dark"]) < min(mean["pan"]) / 3
    step = lambda k: [np.abs(readers.clip_frame(k, i, 20, 24, 40) - readers.clip_frame(k, i - 1, 20, 24, 40)).mean() for i in range(1, 20)]
    assert int(np.argmax(step("cut"))) == 9 and np.mean(step("fast")) > np.mean(step("still"))


def test_spilled_plates_go_at_the_end(spark):
    plates = spark.createDataFrame([(k % 3, k, float(k)) for k in range(30)], "scene int, pos int, value double")
    with pytest.raises(RuntimeError), sinks.spilled(plates) as held:
        assert sorted(map(tuple, held.select(*plates.columns).collect())) == sorted(map(tuple, plates.collect()))
        path = held.inputFiles()[0]
        raise RuntimeError
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_exported_chunks(spark, tmp_path):
    frames = spark.createDataFrame([(c, k, [float(k)]) for c in (1, 2) for k in range(20)], "clip_id long, frame_idx int, plane array<double>")
    flow = spark.createDataFrame([(c, k, 0, 1, 0.5, -0.5) for c in (1, 2) for k in range(0, 20, 5)], "clip_id long, frame_idx int, y int, x int, dx double, dy double")
    sinks.export_chunk(frames, flow, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x/frames")).groupBy("clip_id").count().collect()[0]["count"] == 16
    assert spark.read.parquet(str(tmp_path / "x/flow")).count() == 8
    assert (tmp_path / "x/frames/clip_id=2").is_dir()


def test_a_watched_stream_shows_progress_and_stops(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(100).write.parquet(src)
    told = progress.Progress(total=400)
    spark.streams.addListener(told)
    try:
        with progress.watched(spark, spark.readStream.schema("id long").parquet(src), "play") as (query, rows):
            assert progress.wait_for(query, rows, 100) == 100
            spark.range(100, 200).write.mode("append").parquet(src)
            assert progress.wait_for(query, rows, 200) == 200
            assert query.isActive
        assert not query.isActive
        end = time.monotonic() + 20
        while told.of(query)["state"] != "done" and time.monotonic() < end:
            time.sleep(0.2)
        state = told.of(query)
        assert state["state"] == "done" and state["done"] == 200 and state["ms_row"] > 0 and state["seconds_left"] == pytest.approx(200 * state["ms_row"] / 1000)
    finally:
        spark.streams.removeListener(told)


def test_a_sink_falls_back_once(spark, tmp_path):
    src = str(tmp_path / "src")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    asked = []

    def preferred(rows, batch):
        asked.append(batch)
        raise OSError("no such encoder")

    sink = progress.FirstThatWorks(preferred, lambda rows, batch: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{batch}")))
    q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(asked) == 1 and len(sink.failed) == 1
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/*")).collect()) == list(range(30))
    with pytest.raises(OSError):
        progress.FirstThatWorks(preferred)(spark.range(1), 0)
