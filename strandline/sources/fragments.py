"""A sink of fragments: runs of frames with the sound that belongs to them, each written once whatever tasks fail.

``laid_out`` gives every frame and sound packet its fragment and its place in it.  ``format("fragments")`` writes
the rows of a batch or a stream: a task writes the fragments that it holds below ``_attempts`` and tells the driver
the names of its files in its commit message; the commit moves them to their places and notes them in a manifest.
Files of tasks that failed, or ran twice, are in no message and go with the folder.  A stream's batch that comes
again after its manifest is there changes nothing.

A batch's task writes one file for all its fragments and a list of where each one lies in it, so that the files, and
the driver's work, grow with the tasks and not with the fragments.  A stream's task writes a file for each fragment.

The path is on a file system that pyarrow reaches and all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from ..operators.scan import whole_groups

SIZE, AHEAD = 12, 1.0  # frames of a fragment, seconds that the sound runs ahead
ROWS = "clip string, fragment int, place int, rank int, t double, id long"
NOTED = "clip string, fragment int, file string, row_group int, first long, frames int, packets int"
BY = ["clip", "fragment"]
ORDER = [*BY, "place", "rank", "t", "id"]
GROUP = 1 << 16  # rows after which a row group ends with its last fragment


def laid_out(video: DataFrame, audio: DataFrame, fps: float, size: int = SIZE, ahead: float = AHEAD) -> DataFrame:
    """ROWS: frames (clip, frame_idx from 0, id) and sound packets (clip, t seconds, id) by fragment, in the order in which they are written.

    After a clip's n-th frame the packets up to n / fps + ahead seconds follow, so those after the last frame's are left out.
    """
    frames = video.select(F.col("clip").cast("string").alias("clip"), (F.col("frame_idx") + 1).cast("int").alias("place"), F.lit(0).alias("rank"), (F.col("frame_idx") / fps).alias("t"), F.col("id").cast("long").alias("id"))
    after = F.greatest(F.ceil((F.col("t") - ahead) * fps), F.lit(1)).cast("int")
    sound = audio.select(F.col("clip").cast("string").alias("clip"), after.alias("place"), F.lit(1).alias("rank"), F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id"))
    ends = frames.groupBy("clip").agg(F.max("place").alias("end"))
    kept = sound.join(ends, "clip").where("place <= end").drop("end")
    both = frames.unionByName(kept).withColumn("fragment", F.floor((F.col("place") - 1) / size).cast("int"))
    return both.select(*[f.split()[0] for f in ROWS.split(", ")])


def dealt(rows: DataFrame) -> DataFrame:
    """ROWS as the sink wants them: a fragment in one task, in order (a stream's rows are sorted by the writer)."""
    own = rows.repartition(*BY)
    return own if rows.isStreaming else own.sortWithinPartitions(*ORDER)


@dataclass
class Written(WriterCommitMessage):
    """Fragments of a stream's task: (clip, fragment, file, frames, packets)."""

    parts: list = field(default_factory=list)


@dataclass
class Packed(WriterCommitMessage):
    """Files of a batch's task and their places: (file, place); none if it had no rows."""

    moves: list = field(default_factory=list)


def _row_groups(iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole fragments, of GROUP rows and the rest of a table more, and where the fragments start."""
    held, starts, n = [], [], 0
    for table, at in whole_groups(iterator, BY):
        held.append(table)
        starts.append(at + n)
        n += table.num_rows
        if n >= GROUP:
            yield pa.concat_tables(held), np.concatenate(starts)
            held, starts, n = [], [], 0
    if held:
        yield pa.concat_tables(held), np.concatenate(starts)


def _told(table: pa.Table, starts: np.ndarray, file: str, row_group: int) -> pa.Table:
    """NOTED of the fragments of a row group."""
    sound = np.add.reduceat(table.column("rank").to_numpy(), starts)
    columns = {c: table.column(c).take(pa.array(starts)) for c in BY}
    columns |= {"file": pa.array([file] * len(starts)), "row_group": pa.array([row_group] * len(starts), pa.int32()), "first": pa.array(starts, pa.int64())}
    return pa.table(columns | {"frames": pa.array(np.diff(starts, append=table.num_rows) - sound, pa.int32()), "packets": pa.array(sound, pa.int32())})


class _Files:
    """The sink's folder."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.kinds = fs.FileType

    def there(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type != self.kinds.NotFound

    def put(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        part = f"{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(f"{self.path}/{part}") as f:
            f.write(text.encode())
        self.fs.move(f"{self.path}/{part}", f"{self.path}/{name}")

    def gone(self, name: str) -> None:
        if self.there(name):
            self.fs.delete_dir(f"{self.path}/{name}")


class _Writer:
    def __init__(self, options: dict, overwrite: bool = False):
        if not options.get("path"):
            raise ValueError("fragments need a path")
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _attempt(self) -> tuple[_Files, str]:
        """A fresh folder for what a task writes."""
        files, task = _Files(self.path), TaskContext.get()
        folder = f"_attempts/{self.job}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        files.fs.create_dir(f"{files.path}/{folder}", recursive=True)
        return files, folder

    def _settled(self, moves: list, manifest: str, noted: list) -> None:
        """Moves the told files to their places, puts down the manifest, and drops what else the job has left."""
        files = _Files(self.path)
        for folder in {"fragments", "_manifests", *(to.rpartition("/")[0] for _, to in moves)}:
            files.fs.create_dir(f"{files.path}/{folder}", recursive=True)
        if not files.there(manifest):
            for name, to in moves:
                if files.there(name):  # else an earlier commit of this job, which did not end, has moved it
                    files.fs.move(f"{files.path}/{name}", f"{files.path}/{to}")
            files.put(manifest, json.dumps(noted))
        files.gone(f"_attempts/{self.job}")


class FragmentWriter(_Writer, DataSourceArrowWriter):
    """A task's fragments lie in one file, each whole in a row group; a list beside the manifest tells where."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        files, folder = self._attempt()
        part = f"{TaskContext.get().partitionId():06d}.parquet"
        to = f"fragments/job-{self.job}/{part}"
        moves = [(f"{folder}/rows.parquet", to), (f"{folder}/list.parquet", f"_manifests/job-{self.job}/{part}")]
        with ExitStack() as ends:
            writers: list[pq.ParquetWriter] = []
            for k, (table, starts) in enumerate(_row_groups(iterator)):
                both = table, _told(table, starts, to, k)
                if not writers:
                    for (name, _), rows in zip(moves, both, strict=True):
                        out = ends.enter_context(files.fs.open_output_stream(f"{files.path}/{name}"))
                        writers.append(ends.enter_context(pq.ParquetWriter(out, rows.schema)))
                for writer, rows in zip(writers, both, strict=True):
                    writer.write_table(rows, row_group_size=rows.num_rows)
        return Packed(moves if writers else [])

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for name in ("fragments", "_manifests"):
                _Files(self.path).gone(name)
        moves = [x for m in messages if m for x in m.moves]
        self._settled(moves, f"_manifests/job-{self.job}.json", [{"lists": f"_manifests/job-{self.job}"}] if moves else [])

    def abort(self, messages: list) -> None:
        _Files(self.path).gone(f"_attempts/{self.job}")


class FragmentStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """A file for each fragment; one whose frames come in several batches has a file for each.  A task sorts its part of a micro-batch, which the source's admission bounds."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        (files, folder), out, batches = self._attempt(), Written(), list(iterator)
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ORDER]) if batches else None
        for table, starts in whole_groups(iter(rows.to_batches() if rows else []), BY):
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                own = table.slice(lo, hi - lo)
                clip, fragment = own.column("clip")[0].as_py(), own.column("fragment")[0].as_py()
                name = f"{folder}/{len(out.parts)}.parquet"
                with files.fs.open_output_stream(f"{files.path}/{name}") as f:
                    pq.write_table(own, f, row_group_size=own.num_rows)
                sound = sum(own.column("rank").to_pylist())
                out.parts.append((clip, fragment, name, own.num_rows - sound, sound))
        return out

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        moves, noted = [], []
        for clip, fragment, name, frames, packets in sorted((p for m in messages if m for p in m.parts), key=lambda p: (str(p[0]), p[1])):
            to = f"fragments/{'null' if clip is None else 'clip-' + clip.encode().hex()}/{fragment:08d}-{batchId:010d}.parquet"
            moves.append((name, to))
            noted.append({"clip": clip, "fragment": fragment, "file": to, "row_group": 0, "first": 0, "frames": frames, "packets": packets})
        self._settled(moves, f"_manifests/batch-{batchId:010d}.json", noted)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _Files(self.path).gone(f"_attempts/{self.job}")


class FragmentSink(DataSource):
    """write.format("fragments").option("path", ...) and writeStream likewise; rows as `dealt` gives them."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> FragmentStreamWriter:  # noqa: N802
        return FragmentStreamWriter(dict(self.options), overwrite)


def swept(path: str) -> None:
    """Drops what tasks that outlived their job's abort have left; no job may be writing."""
    _Files(path).gone("_attempts")


def manifest(spark, path: str) -> DataFrame:
    """clip, fragment, file, row_group, first (its first row in that), frames, packets of what has been committed below a path."""
    noted = spark.read.schema(f"{NOTED}, lists string").json(f"{path}/_manifests/*.json")
    lists = [f"{path}/{r.lists}" for r in noted.where("lists is not null").select("lists").collect()]  # a folder a job
    own = noted.where("lists is null").drop("lists")
    return own.unionByName(spark.read.schema(NOTED).parquet(*lists)) if lists else own


def read_fragments(spark, path: str) -> DataFrame:
    """ROWS of the committed fragments below a path."""
    return spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{path}/fragments")
