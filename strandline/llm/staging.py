"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and all tasks run in this process, as in tests.

    On a cluster without that setting this is an error: no other folder is known to be shared."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: set[str] = set()  # by this process, and not deleted yet
_inside: ContextVar[list[str] | None] = ContextVar("inside", default=None)  # by the scratch block of this thread


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    if (inside := _inside.get()) is not None:
        inside.append(path)
    return path


#: Bytes of a batch of rows on its way to Python; whole texts travel, and a task holds a batch on either side.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside send batches of at most BATCH bytes, or a row, to Python."""
    before = {c: spark.conf.get(c) for c in BATCH}
    try:
        for c, v in BATCH.items():
            spark.conf.set(c, v)
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes the rows once and reads them back, so that later jobs and lost executors do not
    repeat the work and row numbers given before stay as they are.  options: of the parquet writer."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _made.discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables staged inside, by this thread, go at the end, but for those that the block puts into the list."""
    kept: list[DataFrame] = []
    outer, token = _inside.get(), _inside.set([])
    try:
        yield kept
        stay = {df.staged_path for df in kept}
        _delete(spark, [p for p in _inside.get() if p in _made and p not in stay])
        if outer is not None:
            outer += stay
    finally:
        _inside.reset(token)


#: Plan nodes over a scan of parquet files that leave each row its file and place.
STEADY = ("FileSourceScanExec", "ProjectExec", "FilterExec", "ColumnarToRowExec")


def _nodes(plan) -> Iterator:
    yield plan
    below = plan.children()
    for k in range(below.size()):
        yield from _nodes(below.apply(k))


def steady(df: DataFrame) -> DataFrame:
    """df if it only scans parquet files and projects, the same on each pass, so that a row has a file and a place in it; else its rows, written once."""
    query = df._jdf.queryExecution()
    own = [(n, n.getClass().getSimpleName()) for n in _nodes(query.sparkPlan())]
    scans = [n for n, kind in own if kind == "FileSourceScanExec"]
    fine = query.analyzed().deterministic() and all(kind in STEADY for _, kind in own) and len(scans) == 1 and scans[0].relation().fileFormat().toString() == "Parquet"
    return df if fine else staged(df, "rows")


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A few rows of the driver, sent by Arrow: a list of tuples would start Python workers to take it apart."""
    return spark.createDataFrame(pa.table(columns))


MOST_FILES = 1 << 18  # whose paths the driver numbers; 16 bytes each travel to all tasks


def numbered(df: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """row, a struct of all columns of df, whatever their names, and uid, its number: from its file (in order of paths) and its place in the file.

    How a scan is split depends on the cores of that moment; file and place don't.  Tables of more than `most` files
    are written once with their numbers."""
    df = steady(df)
    meta = df.metadataColumn("_metadata")  # also where df has a column of that name
    path = meta["file_path"]
    files = df.select(path.alias("path")).distinct().select("path", F.xxhash64("path").alias("file")).limit(most + 1).collect()
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
    if len(files) > most or len({f["file"] for f in files}) < len(files):
        return staged(df.select(row, F.monotonically_increasing_id().alias("uid")), "rows")
    base = {f["file"]: k << 40 for k, f in enumerate(sorted(files, key=lambda f: f["path"]))}
    known = local_table(df.sparkSession, {"file": pa.array(list(base), pa.int64()), "base": pa.array(list(base.values()), pa.int64())})
    rows = df.select(row, F.xxhash64(path).alias("file"), meta["row_index"].alias("place"))
    return rows.join(F.broadcast(known), "file").select("row", (F.col("base") + F.col("place")).alias("uid"))


def texts_of(rows: DataFrame) -> DataFrame:
    """uid, doc_id and text of numbered rows."""
    return rows.select("uid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    _delete(spark, [t.staged_path for t in tables])


def cleaned(spark: SparkSession) -> None:
    """Deletes every table that this process has staged; results read from them before must be written first."""
    _delete(spark, sorted(_made))
