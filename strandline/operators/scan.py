"""Recurrences along a stream in two passes over blocks of it, so that one long stream is worked out by many tasks.

Rows are cut into blocks by their order number.  The first pass describes what a block does to the state that
enters it, in a few numbers; these rows are folded along the stream, which gives the state that enters each
block; the second pass works out the rows.  Streams that lie in one block need no first pass.  Inside a
block numpy does all rows at once: moving averages as composed affine maps by doubling, budgets by pointers
to the next promotion, found in running sums and followed by doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import ordered_fold

BLOCK = 1 << 16  # order numbers of a block
STEPS = 512


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row begins a new group of equal keys; nulls are equal."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in keys:
        v = rows.column(c).combine_chunks()
        off = pc.not_equal(v.slice(1), v.slice(0, len(v) - 1))
        nulls = pc.is_null(v).to_numpy(zero_copy_only=False)
        new[1:] |= pc.fill_null(off, False).to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys out of sorted batches, and where the groups start; one group is held over a border at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([*held, b])
        new = _starts(rows, keys)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield rows.slice(0, last), np.flatnonzero(new[:last])
        held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.flatnonzero(_starts(rows, keys))


def _values(rows: pa.Table, column: str) -> np.ndarray:
    """A column as floats, NaN for nulls; flags as booleans, false for nulls."""
    v = rows.column(column).combine_chunks()
    if pa.types.is_boolean(v.type):
        return pc.fill_null(v, False).to_numpy(zero_copy_only=False)
    return pc.cast(v, pa.float64()).to_numpy(zero_copy_only=False)


def in_blocks(df: DataFrame, key: list[str], order: str, described: Callable, summary: str, fold: Callable, rows: Callable, added: str, block: int) -> DataFrame:
    """df with columns `added`, worked out in blocks of `block` order numbers.

    described(table, starts): for each block the columns of `summary`.  fold(state, *summary): the state behind a block, from
    the state before it; a state is a float, NaN where a stream has none yet.  rows(table, starts, entry): the added columns,
    entry being the state before each block."""
    own = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    on = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    cut = own.groupBy(*key).agg(F.min("__block").alias("__lo"), F.max("__block").alias("__hi")).where("__hi > __lo").select(*key)
    long = own.alias("o").join(cut.alias("c"), on("o", "c", key), "left_semi")
    by, place = [*key, "__block"], [*key, "__block", order]
    fields = T._parse_datatype_string(summary).fields
    schema = T.StructType([*(df.schema[c] for c in key), T.StructField("__block", T.LongType()), *fields])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, by):
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(table.column(c).take(at).combine_chunks() for c in by), *described(table, starts)], schema.names)

    told = long.repartition(*by).sortWithinPartitions(*place).mapInArrow(first, schema)

    def step(state: list, *values) -> tuple:
        before = state[0]
        state[0] = fold(before, *values)
        return (before,)

    # one narrow row a block
    entry = ordered_fold(told, key, ["__block"], [f.name for f in fields], lambda: [float("nan")], step, "__entry double").select(*by, "__entry")
    kinds = T._parse_datatype_string(added)
    columns, out = df.columns, T.StructType(df.schema.fields + kinds.fields)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, by):
            cols = rows(table, starts, _values(table, "__entry")[starts])
            kept = table.select(columns).combine_chunks()
            yield from pa.table([*kept.columns, *cols], names=out.names).to_batches()

    both = own.alias("a").join(entry.alias("b"), on("a", "b", by), "left").select("a.*", "b.__entry")
    return both.repartition(*by).sortWithinPartitions(*place).mapInArrow(second, out)


def affine_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the maps s -> a*s + b give one after the other, from 0, by doubling; each run must begin with a = 0."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a) and a.any():
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        a[:step] = 0
        step *= 2
    return b


def stepped_scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same row after row, in the order of a walk and so to the last bit, for all runs side by side."""
    at = np.arange(len(a))
    place = at - np.maximum.accumulate(np.where(a == 0, at, 0))
    out, order = b.copy(), np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(place.max(initial=0) + 2))
    for k in range(1, len(cuts) - 1):
        rows = order[cuts[k] : cuts[k + 1]]
        out[rows] = a[rows] * out[rows - 1] + b[rows]
    return out


def scanned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Runs of up to STEPS rows step by step, longer ones by doubling."""
    starts = np.flatnonzero(a == 0)
    short = not len(a) or np.diff(np.append(starts, len(a))).max() <= STEPS
    return stepped_scan(a, b) if short else affine_scan(a, b)


def averaged(values: np.ndarray, again: np.ndarray, use: np.ndarray, starts: np.ndarray, entry: np.ndarray, alpha: float) -> np.ndarray:
    """Moving average behind each row: blocks begin at `starts` with the state `entry` (NaN: none), `again` forgets it, rows in use join it."""
    n, at = len(values), np.arange(len(values))
    new, before = np.zeros(n, bool), np.full(n, np.nan)
    new[starts], before[starts] = True, entry
    # the last row that says whether there is a state: 1 there is one, 0 there is none
    kind = np.where(use, 1, np.where(again, 0, np.where(new, np.isfinite(before), -1)))
    has = kind[np.maximum.accumulate(np.where(kind >= 0, at, 0))] == 1
    held = np.where(again, False, np.where(new, np.isfinite(before), np.concatenate(([False], has[:-1]))))
    joins, first = use & held, new | again
    v = np.where(use, values, 0.0)
    base = np.where(new & ~again, np.nan_to_num(before), 0.0)
    a = np.where(joins, np.where(first, 0.0, 1.0 - alpha), np.where(use | first | ~held, 0.0, 1.0))
    b = np.where(joins, alpha * v + np.where(first, (1.0 - alpha) * base, 0.0), np.where(use, v, np.where(first, base, 0.0)))
    return np.where(has, scanned(a, b), np.nan)


def ema(df: DataFrame, key: list[str], order: str, value: str, alpha: float, again: str, use: str, block: int = BLOCK) -> DataFrame:
    """df with `ema`: of value along each stream, anew after rows with `again`, passed on by rows without `use` or a value."""

    def used(table: pa.Table) -> tuple:
        v = _values(table, value)
        return v, _values(table, again), _values(table, use) & ~np.isnan(v)

    def described(table: pa.Table, starts: np.ndarray) -> list[pa.Array]:
        v, r, k = used(table)
        ends = np.append(starts[1:], table.num_rows) - 1
        none = averaged(v, r, k, starts, np.full(len(starts), np.nan), alpha)[ends]
        zero = averaged(v, r, k, starts, np.zeros(len(starts)), alpha)[ends]
        fresh = np.logical_or.reduceat(r, starts)
        share = np.where(fresh, 0.0, (1.0 - alpha) ** np.add.reduceat(k.astype(int), starts))
        return [pa.array(none), pa.array(zero), pa.array(share)]

    def fold(state: float, none: float, zero: float, share: float) -> float:
        return none if np.isnan(state) else zero + share * state

    def rows(table: pa.Table, starts: np.ndarray, entry: np.ndarray) -> list[pa.Array]:
        out = averaged(*used(table), starts, entry, alpha)
        return [pa.array(out, mask=np.isnan(out))]

    return in_blocks(df, key, order, described, "none double, zero double, share double", fold, rows, "ema double", block)


class Budget:
    """Chains of promotions in rows of shares: forced rows set the sum to 0, a row whose sum reaches the budget is promoted and sets it to 0 after it."""

    def __init__(self, shares: np.ndarray, forced: np.ndarray, starts: np.ndarray, budget: float):
        self.shares, self.forced, self.budget = np.where(forced, 0.0, shares), forced, budget
        n = len(shares)
        self.sums = np.concatenate(([0.0], np.cumsum(self.shares, dtype=np.longdouble)))  # before each row, and at the end
        self.ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))  # of each row's block
        stops = np.where(forced, np.arange(n), n)
        ahead = np.minimum.accumulate(stops[::-1])[::-1] if n else stops
        self.stop = np.minimum(np.append(ahead, n), n)  # the first forced row from here on

    def reached(self, first: np.ndarray, end: np.ndarray, spent: np.ndarray) -> np.ndarray:
        """The first row of [first, end) at which the sum from `spent` on reaches the budget, `end` where none does; a forced row ends the search."""
        limit = np.minimum(end, self.stop[first])
        want = self.sums[first] - spent + self.budget
        row = np.searchsorted(self.sums[1:], want, "left")
        near = 1e-9 * (1.0 + np.abs(want))
        lo, hi = (np.maximum(np.searchsorted(self.sums[1:], w, "left"), first) for w in (want - near, want + near))
        # where rounding may decide, sums are added up in order, as along the stream
        for k in np.flatnonzero((lo < hi) & (lo < limit)):
            exact = np.cumsum(np.concatenate(([spent[k]], self.shares[first[k] : min(hi[k] + 1, limit[k])])))[1:]
            hit = np.flatnonzero(exact >= self.budget)
            row[k] = first[k] + hit[0] if len(hit) else limit[k]
        row = np.maximum(row, first)
        return np.where(row < limit, row, limit)

    def next(self) -> np.ndarray:
        """For each row, when it set the sum to 0: the next row that does so, or the end of its block."""
        at = np.arange(len(self.shares))
        return self.reached(at + 1, self.ends, np.zeros(len(at))) if len(at) else at


def _last_zero(nxt: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row that sets the sum to 0: the last one in its block on the chain from it."""
    at = np.arange(len(nxt))
    last = np.where(nxt < ends, nxt, at)
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def budget(df: DataFrame, key: list[str], order: str, share: str, forced: str, limit: float, block: int = BLOCK) -> DataFrame:
    """df with promoted and spent: shares add up along each stream and promote a row when they reach the limit, after which they begin anew.

    Forced rows and a stream's first one spend nothing.  Shares are not negative; a null one adds nothing."""

    def parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v, f = _values(table, share), _values(table, forced)
        return np.where(f | np.isnan(v), 0.0, v), f

    def described(table: pa.Table, starts: np.ndarray) -> list[pa.Array]:
        shares, f = parts(table)
        ends = np.append(starts[1:], len(shares))
        none, bounds, exits, heads = [], [], [], []
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            own = Budget(shares[lo:hi], f[lo:hi], np.zeros(1, int), limit)
            last = _last_zero(own.next(), own.ends)
            tail = {int(r): float(np.cumsum(own.shares[r + 1 :])[-1]) if r + 1 < hi - lo else 0.0 for r in np.unique(last)}
            none.append(tail[int(last[0])])  # the stream's first row is forced
            # the entering sum is below the limit, so it decides within the rows that reach the limit by themselves or up to a forced row
            stop = int(own.stop[0])
            sums = np.cumsum(own.shares[:stop])
            head = min(int(np.searchsorted(sums, limit, "left")) + 1, stop)
            rows = np.arange(min(head + 1, hi - lo))
            leads = last[rows]  # promoting such a row first leads to that exit
            new = np.flatnonzero(np.concatenate(([True], leads[1:] != leads[:-1])))
            bounds.append([float(x) for x in rows[new]])
            exits.append([tail[int(r)] for r in leads[new]])
            heads.append([float(stop if stop < hi - lo else -1), *own.shares[:head].tolist()])
        lists = pa.list_(pa.float64())
        return [pa.array(none), pa.array(bounds, lists), pa.array(exits, lists), pa.array(heads, lists)]

    def fold(state: float, none: float, bounds: list[float], exits: list[float], head: list[float]) -> float:
        if np.isnan(state):
            return none
        sums = np.cumsum([state, *head[1:]])[1:]
        hit = np.flatnonzero(sums >= limit)
        if not len(hit) and head[0] < 0:
            return float(sums[-1])
        row = float(hit[0]) if len(hit) else head[0]
        return exits[int(np.searchsorted(bounds, row, "right")) - 1]

    def rows(table: pa.Table, starts: np.ndarray, entry: np.ndarray) -> list[pa.Array]:
        shares, f = parts(table)
        n, ends = len(shares), np.append(starts[1:], len(shares))
        f = f.copy()
        f[starts] |= np.isnan(entry)
        own = Budget(shares, f, starts, limit)
        nxt = own.next()
        zero = f.copy()
        going = np.flatnonzero(~f[starts])
        if len(going):
            head = own.reached(starts[going], ends[going], entry[going])
            zero[head[head < ends[going]]] = True
        jump, end_of = nxt, own.ends
        reach = zero.copy()
        while True:
            to = jump[reach]
            to = to[to < end_of[reach]]
            if reach[to].all():
                break
            reach[to] = True
            jump = np.where(jump < end_of, jump[np.minimum(jump, n - 1)], jump)
        promoted = reach & ~f
        at = np.maximum.accumulate(np.where(reach, np.arange(n), -1))
        block_start = np.repeat(starts, np.diff(np.append(starts, n)))
        before = np.concatenate(([-1], at[:-1]))
        behind = np.where(before >= block_start, before + 1, block_start)
        base = np.where(before >= block_start, 0.0, np.repeat(np.nan_to_num(entry), np.diff(np.append(starts, n))))
        spent = np.where(f, 0.0, base + (own.sums[1:] - own.sums[behind])).astype(float)
        return [pa.array(promoted), pa.array(spent)]

    return in_blocks(df, key, order, described, "none double, bounds array<double>, exits array<double>, head array<double>", fold, rows, "promoted boolean, spent double", block)
