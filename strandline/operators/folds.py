"""Ordered folds: state that depends on its own output.

The rows of a stream are dealt by its key and sorted in the task; a small function then walks
them with constant state, batch after batch, so a stream's length is not bounded by memory.
Such a fold is sequential: streams run side by side, the rows of one stream do not.  Recurrences whose steps
compose (moving averages, budgets) are worked out in blocks of a stream instead, see scan.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str | list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, added: str) -> DataFrame:
    """df with columns `added`, which `step(state, *inputs)` gives for each row in order as a tuple.

    `start()` makes the state of a new stream.  Rows keep their order within a stream.
    """
    from pyspark.sql import types as T

    keys = [key] if isinstance(key, str) else key
    kinds = T._parse_datatype_string(added)
    schema = T.StructType(df.schema.fields + kinds.fields)
    names = [f.name for f in schema.fields]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [arrow[f.dataType.simpleString()] for f in kinds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, begun = None, None, False
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, *inputs)), strict=True):
                k, values = row[: len(keys)], row[len(keys) :]
                if not begun or k != held:
                    held, state, begun = k, start(), True
                out.append(step(state, *values))
            cols = zip(*out, strict=True) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
