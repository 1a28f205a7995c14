"""Progress of streams, sinks with a second choice, and streams that are watched while they run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..shared import shared_path


class Progress(StreamingQueryListener):
    """State, rows done, ms a row and seconds left of each query by its id; total: rows that will come, if known."""

    def __init__(self, total: int | None = None):
        self.total, self._lock, self._held = total, Lock(), {}

    def _put(self, key, **values) -> None:
        with self._lock:
            self._held.setdefault(str(key), {"state": "running", "done": 0, "ms": 0.0} | values).update(values)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._put(event.id, state="running")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            own = self._held.setdefault(str(p.id), {"state": "running", "done": 0, "ms": 0.0})
            own["done"] += p.numInputRows
            own["ms"] += p.durationMs.get("triggerExecution", 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._put(event.id, state="idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(event.id, state="failed" if event.exception else "done")

    def of(self, query: StreamingQuery) -> dict:
        with self._lock:
            own = dict(self._held.get(str(query.id), {"state": "unknown", "done": 0, "ms": 0.0}))
        own["ms_row"] = own["ms"] / own["done"] if own["done"] else None
        left = None if self.total is None or own["ms_row"] is None else max(self.total - own["done"], 0)
        return own | {"seconds_left": None if left is None else left * own["ms_row"] / 1000}


class FirstThatWorks:
    """A foreachBatch function: each batch goes to the first writer that takes it; one that failed is not asked again.

    Writers get (rows, batch number) and must be safe to repeat, as a batch may come again."""

    def __init__(self, *writers: Callable[[DataFrame, int], None]):
        self.writers, self.failed = list(writers), []

    def __call__(self, rows: DataFrame, batch: int) -> None:
        while True:
            try:
                return self.writers[0](rows, batch)
            except Exception as e:
                if len(self.writers) == 1:
                    raise
                self.failed.append((self.writers.pop(0), e))


@contextmanager
def watched(spark: SparkSession, stream: DataFrame, name: str, trigger: str = "0 seconds") -> Iterator[tuple[StreamingQuery, Callable[[], DataFrame]]]:
    """Runs a stream in append mode while the block reads what is finished; leaving the block stops it, also after an error."""
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(processingTime=trigger).outputMode("append").start()
    try:
        yield query, lambda: spark.read.schema(stream.schema).parquet(out)
    finally:
        query.stop()


#: Spark's names for a table whose folder is not there.
NOTHING_YET = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def wait_for(query: StreamingQuery, rows: Callable[[], DataFrame], least: int, seconds: float = 60.0) -> int:
    """Waits until the finished rows are `least` or more; their number.  A stream that failed raises its error."""
    end = time.monotonic() + seconds
    while True:
        try:
            n = rows().count()
        except AnalysisException as e:
            if e.getCondition() not in NOTHING_YET:
                raise
            n = 0
        if n >= least or time.monotonic() > end:
            return n
        if query.exception():
            raise query.exception()
        time.sleep(0.2)
