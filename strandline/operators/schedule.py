"""Schedules of a producer with a bounded buffer: closed forms and a simulation per parameter set."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utilisation(latency: Column, fps: Column, cost: Column, every: Column, dedicated: Column) -> Column:
    """Load of the busiest server: one does both kinds of work, or anchors have a server of their own."""
    frames, anchors = fps * cost, fps / every * latency
    return F.when(dedicated, F.greatest(frames, anchors)).otherwise(frames + anchors)


def least_interval(latency: Column, fps: Column, cost: Column, dedicated: Column) -> Column:
    """Smallest anchor interval in frames that can be kept up; infinite if plain frames fill the time."""
    spare = 1.0 / fps - cost
    return F.when(dedicated, latency * fps).when(spare <= 0, F.lit(float("inf"))).otherwise(latency / spare)


def least_buffer(latency: Column, fps: Column) -> Column:
    return F.ceil(latency * fps - 1e-9).cast("int")


def startup(latency: Column, fps: Column, cost: Column, dedicated: Column) -> Column:
    fill = least_buffer(latency, fps) * cost
    return F.when(dedicated, F.greatest(latency, fill)).otherwise(latency + fill)


def stalls(latency: float, fps: float, cost: float, every: int, dedicated: bool, buffer: int, n: int) -> tuple[int, float, float]:
    """Frames shown late, start of playback and time of the last frame.

    A frame is made when the server is free and a buffer slot is; it is shown a period after the one
    before, or when it is made if that is later.  Only the last `buffer` show times are kept.
    """
    buffer = max(1, min(buffer, n))
    period, made, shown, late = 1.0 / fps, 0.0, deque(), 0
    start, last = 0.0, 0.0
    for i in range(n):
        anchor = i % every == 0
        ready = made if i < buffer else max(made, shown.popleft())
        if anchor and dedicated:
            ready = max(ready, (i // every + 1) * latency)
        made = ready + cost + (latency if anchor and not dedicated else 0.0)
        if i < buffer - 1:
            continue
        if i == buffer - 1:
            start = made
            shown.extend(start + k * period for k in range(buffer))
            last = shown[-1]
            continue
        due = last + period
        late += made > due + 1e-9
        last = made if made > due + 1e-9 else due
        shown.append(last)
    return late, start, last


SIM = "stalls int, start double, last double"


def simulated(params: DataFrame, n: int = 240) -> DataFrame:
    """params (latency, fps, cost, every, dedicated, buffer, ...) with stalls, start and last; each row on its own."""
    from pyspark.sql import types as T

    schema = T.StructType(params.schema.fields + T._parse_datatype_string(SIM).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [stalls(*r, n) for r in zip(*(b.column(c).to_pylist() for c in ("latency", "fps", "cost", "every", "dedicated", "buffer")), strict=True)]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [f.name for f in schema.fields])

    return params.mapInArrow(run, schema)


def parameter_grid(spark, latencies, rates, costs, everies, dedicated=(False, True)) -> DataFrame:
    """All combinations of parameter values; each list is a small constant."""
    values = lambda name, xs, kind: F.explode(F.array(*[F.lit(x).cast(kind) for x in xs])).alias(name)
    df = spark.range(1).select(values("latency", latencies, "double"))
    for name, xs, kind in (("fps", rates, "double"), ("cost", costs, "double"), ("every", everies, "int"), ("dedicated", dedicated, "boolean")):
        df = df.select("*", values(name, xs, kind))
    return df


def minimal_buffer(params: DataFrame, most: int, n: int = 240) -> DataFrame:
    """Smallest buffer up to `most` without a stall for each sustainable parameter set, null if there is none."""
    load = utilisation(F.col("latency"), F.col("fps"), F.col("cost"), F.col("every"), F.col("dedicated"))
    own = params.withColumn("load", load)
    tried = simulated(own.where("load <= 1 + 1e-9").withColumn("buffer", F.explode(F.sequence(F.lit(1), F.lit(most)))), n)
    best = tried.where("stalls = 0").groupBy("latency", "fps", "cost", "every", "dedicated").agg(F.min("buffer").alias("min_buffer"))
    return own.join(best, ["latency", "fps", "cost", "every", "dedicated"], "left")
