"""Fragments: their layout against a plain muxer, and a sink whose tasks fail or whose batches come again."""

import math
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.sources import fragments


def muxed(n, fps, packets, size=12, ahead=1.0):
    """Frames and packets as a muxer gets them one after the other: [(fragment, kind, id)]."""
    out, waiting = [], sorted(packets)
    for k in range(n):
        out.append((k // size, "v", k))
        while waiting and waiting[0][0] <= (k + 1) / fps + ahead + 1e-12:
            out.append((k // size, "a", waiting.pop(0)[1]))
    return out


def rows_of(spark, clips=3, n=40):
    video = spark.range(clips * n).select((F.col("id") % clips).alias("clip"), F.floor(F.col("id") / clips).alias("frame_idx"), F.floor(F.col("id") / clips).alias("id"))
    audio = spark.range(clips * 300).select((F.col("id") % clips).alias("clip"), (F.floor(F.col("id") / clips) / 43.0).alias("t"), (F.floor(F.col("id") / clips) + 1000).alias("id"))
    return video, audio


def test_layout_equals_a_muxer(spark):
    video, audio = rows_of(spark)
    got = fragments.laid_out(video, audio, 25.0).where("clip = '1'").orderBy("place", "rank", "t").collect()
    want = muxed(40, 25.0, [(k / 43.0, k + 1000) for k in range(300)])
    assert [(r.fragment, "av"[1 - r.rank], r.id) for r in got] == want
    assert max(r.t for r in got if r.rank) <= 40 / 25 + 1 and math.isclose(max(r.fragment for r in got), 3)


@pytest.fixture(scope="module")
def sink(spark):
    spark.dataSource.register(fragments.FragmentSink)
    return spark


def state(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and "/_attempts/" not in str(p))


def same(spark, path, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, fragments.read_fragments(spark, path).collect()), key=key) == sorted(map(tuple, rows.collect()), key=key)


def test_a_batch_writes_each_fragment_once(sink, tmp_path):
    path = str(tmp_path / "out")
    rows = fragments.laid_out(*rows_of(sink), 25.0)
    fragments.dealt(rows).write.format("fragments").option("path", path).mode("append").save()
    same(sink, path, rows)
    told = fragments.manifest(sink, path).collect()
    assert len(told) == len({(r.clip, r.fragment) for r in told}) == 12 and all((Path(path) / r.file).exists() for r in told)
    assert {r.frames for r in told} == {12, 4} and sum(r.frames for r in told) == 120
    assert not list(Path(path).glob("_attempts/*"))
    fragments.dealt(rows.where("clip = '2'")).write.format("fragments").option("path", path).mode("overwrite").save()
    same(sink, path, rows.where("clip = '2'"))


def test_failed_tasks_leave_nothing(sink, tmp_path):
    path = str(tmp_path / "out")
    rows = fragments.laid_out(*rows_of(sink), 25.0)

    def dies(batches):
        for k, b in enumerate(batches):
            yield b
            raise RuntimeError("a task dies after its first rows")

    with pytest.raises(Exception, match="a task dies"):
        fragments.dealt(rows).mapInArrow(dies, fragments.ROWS).write.format("fragments").option("path", path).mode("append").save()
    assert state(path) == []
    fragments.swept(path)  # of tasks that were still running at the abort
    assert not list(Path(path).glob("_attempts/*"))


def test_a_repeated_attempt_counts_once(tmp_path):
    """Two attempts of one task write; the driver hears of the second one alone, and commits twice."""
    import pyarrow as pa

    path = str(tmp_path / "out")
    os.makedirs(path)
    writer = fragments.FragmentStreamWriter({"path": path})

    class Task:
        partitionId = attemptNumber = staticmethod(lambda: 0)

    batch = pa.RecordBatch.from_pydict({"clip": ["a"] * 3, "fragment": pa.array([0, 0, 1], pa.int32()), "place": pa.array([1, 2, 13], pa.int32()), "rank": pa.array([0, 1, 0], pa.int32()), "t": [0.0, 0.1, 0.5], "id": [1, 2, 3]})
    before, fragments.TaskContext.get = fragments.TaskContext.get, staticmethod(lambda: Task)
    try:
        writer.write(iter([batch]))
        second = writer.write(iter([batch]))
    finally:
        fragments.TaskContext.get = before
    writer.commit([second, None], 5)
    once = state(path)
    assert len([f for f in once if f.startswith("fragments/")]) == 2 and "_manifests/batch-0000000005.json" in once
    again = fragments.FragmentStreamWriter({"path": path})
    fragments.TaskContext.get = staticmethod(lambda: Task)
    try:
        third = again.write(iter([batch]))
    finally:
        fragments.TaskContext.get = before
    again.commit([third], 5)  # the batch comes again after a restart
    assert state(path) == once and not list(Path(path).glob("_attempts/*"))
    again.abort([], 6)


def test_a_stream_stopped_between_batches_goes_on(sink, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = fragments.laid_out(*rows_of(sink, 2, 60), 25.0)
    for k in range(3):
        rows.where(F.floor((F.col("place") - 1) / 20) == k).coalesce(1).write.parquet(f"{source}/{k}")

    def run(to):
        stream = sink.readStream.schema(fragments.ROWS).option("maxFilesPerTrigger", 1).parquet(f"{source}/{to}")
        q = fragments.dealt(stream).writeStream.format("fragments").option("path", path).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    run("[01]")
    run("*")
    same(sink, path, rows)
    assert sum(r.frames for r in fragments.manifest(sink, path).collect()) == 120


def test_files_of_a_batch_grow_with_its_tasks(sink, tmp_path):
    """a thousand fragments in two tasks are two files, and the list tells where each fragment lies."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "out")
    rows = fragments.laid_out(*rows_of(sink, 50, 240), 25.0).localCheckpoint()
    fragments.dealt(rows).coalesce(2).write.format("fragments").option("path", path).mode("append").save()
    data = [f for f in state(path) if f.startswith("fragments/") and f.endswith(".parquet")]
    lists = [f for f in state(path) if f.startswith("_manifests/") and f.endswith(".parquet")]
    assert 1 <= len(data) == len(lists) <= 2
    same(sink, path, rows)
    told = fragments.manifest(sink, path).collect()
    assert len(told) == len({(r.clip, r.fragment) for r in told}) == 1000 and {r.file for r in told} == set(data)
    want = {}
    for r in rows.orderBy(*fragments.ORDER).collect():
        want.setdefault((r.clip, r.fragment), []).append(tuple(r))
    for r in told:
        own = pq.ParquetFile(Path(path) / r.file).read_row_group(r.row_group).slice(r.first, r.frames + r.packets).to_pylist()
        assert [tuple(x.values()) for x in own] == want.pop((r.clip, r.fragment)) and sum(x["rank"] for x in own) == r.packets
    assert not want


def test_fragments_lie_whole_in_row_groups(monkeypatch):
    import pyarrow as pa

    n = 60
    made = {"clip": ["a"] * 30 + [None] * 30, "fragment": pa.array([k // 7 for k in range(n)], pa.int32()), "place": pa.array(range(1, n + 1), pa.int32()), "rank": pa.array([k % 2 for k in range(n)], pa.int32()), "t": [k / 25 for k in range(n)], "id": list(range(n))}
    batches = pa.Table.from_pydict(made).to_batches(max_chunksize=4)
    monkeypatch.setattr(fragments, "GROUP", 16)
    got = list(fragments._row_groups(iter(batches)))
    assert len(got) > 2 and pa.concat_tables([g for g, _ in got]).to_pydict() == pa.Table.from_pydict(made).to_pydict()
    keys = [[(t.column("clip")[k].as_py(), t.column("fragment")[k].as_py()) for k in at.tolist()] for t, at in got]
    flat = [k for g in keys for k in g]
    assert len(flat) == len(set(flat)) == 10  # the fragment at the border of the clips counts for each
    told = [r for (t, at) in got for r in fragments._told(t, at, "f", 0).to_pylist()]
    assert sum(r["frames"] for r in told) == sum(r["packets"] for r in told) == 30


def test_a_batch_without_rows_reads_back_empty(sink, tmp_path):
    path = str(tmp_path / "out")
    rows = fragments.laid_out(*rows_of(sink), 25.0).where("clip = 'none'")
    fragments.dealt(rows).write.format("fragments").option("path", path).mode("append").save()
    assert fragments.read_fragments(sink, path).count() == fragments.manifest(sink, path).count() == 0


def test_a_batch_counts_one_attempt_of_a_task(sink, tmp_path, monkeypatch):
    """Two attempts of one task write; the driver hears of the second one alone, and of a task without rows."""
    import pyarrow as pa

    path = str(tmp_path / "out")

    class Task:
        partitionId = attemptNumber = staticmethod(lambda: 0)

    monkeypatch.setattr(fragments.TaskContext, "get", staticmethod(lambda: Task))
    batch = pa.RecordBatch.from_pydict({"clip": ["a"] * 3, "fragment": pa.array([0, 0, 1], pa.int32()), "place": pa.array([1, 2, 13], pa.int32()), "rank": pa.array([0, 1, 0], pa.int32()), "t": [0.0, 0.1, 0.5], "id": [1, 2, 3]})
    writer = fragments.FragmentWriter({"path": path})
    writer.write(iter([batch]))
    told = [writer.write(iter([batch])), writer.write(iter([])), None]
    writer.commit(told)
    once = state(path)
    writer.commit(told)
    assert state(path) == once and not list(Path(path).glob("_attempts/*"))
    assert sorted(r.id for r in fragments.read_fragments(sink, path).collect()) == [1, 2, 3]
    assert sorted((r.fragment, r.first, r.frames, r.packets) for r in fragments.manifest(sink, path).collect()) == [(0, 0, 1, 1), (1, 2, 1, 0)]
