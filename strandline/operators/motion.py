"""Motion records: filters, projection, rasterising into a grid, and the signals taken from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, regions
from .choice import medians
from .scan import whole_groups


def direction(mvs: DataFrame, want: str = "all") -> DataFrame:
    """past keeps source < 0, future keeps source > 0, all keeps every record."""
    if want not in ("past", "future", "all"):
        raise ValueError(f"unknown direction {want!r}")
    return mvs if want == "all" else mvs.where(F.col("source") < 0 if want == "past" else F.col("source") > 0)


def projected(mvs: DataFrame) -> DataFrame:
    """dx and dy in pixels (a scale of 0 counts as 1), and the block's area."""
    scale = F.coalesce(F.nullif(F.col("motion_scale"), F.lit(0)), F.lit(1))
    return mvs.withColumn("dx", F.col("motion_x") / scale).withColumn("dy", F.col("motion_y") / scale).withColumn("area", F.col("w") * F.col("h"))


def unpacked(packed: DataFrame, column: str = "packed") -> DataFrame:
    """Records of a packed array of stride 10, as columns, with mv_idx."""
    names = ["source", "w", "h", "src_x", "src_y", "dst_x", "dst_y", "motion_x", "motion_y", "motion_scale"]
    rest = [c for c in packed.columns if c != column]
    starts = F.when(F.size(column) >= 10, F.sequence(F.lit(0), (F.size(column) / 10).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    rows = packed.select(*rest, column, F.explode(starts).alias("mv_idx"))
    return rows.select(*rest, "mv_idx", *[F.get(column, F.col("mv_idx") * 10 + k).alias(n) for k, n in enumerate(names)])


def audit(mvs: DataFrame) -> DataFrame:
    """Per frame: records, past and future ones, the largest |source| and how many exceed 1."""
    return mvs.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("nmv"),
        F.count_if(F.col("source") < 0).alias("n_past"),
        F.count_if(F.col("source") > 0).alias("n_future"),
        F.max(F.abs("source")).alias("max_source"),
        F.count_if(F.abs("source") > 1).alias("n_far"),
    )


FIELD_BYTES = 1 << 26  # of the fields that a task holds side by side


def dealt(records: DataFrame) -> DataFrame:
    """Records with `turn`, their number in the frame: a frame's records lie together, in order, in one task.

    The window's own partitioning serves, so records that come dealt by frame are not shuffled again."""
    return records.withColumn("turn", F.row_number().over(Window.partitionBy("frame_id").orderBy("mv_idx")) - 1)


def _geometry(mvs: DataFrame) -> DataFrame:
    """Records that paint something: frame_id, mv_idx, dst_x, dst_y, w, h as long, dx, dy as double, and the columns that mvs has beside."""
    used = ["dst_x", "dst_y", "w", "h", "motion_x", "motion_y"]
    own = projected(mvs.dropna(subset=["frame_id", "mv_idx", *used]))
    return own.withColumns({c: F.col(c).cast("long") for c in ("frame_id", "mv_idx", *used[:4])} | {c: F.col(c).cast("double") for c in ("dx", "dy")})


def painted(mvs: DataFrame, grid_w: int, grid_h: int, fn: Callable, schema: str, layer: Column | None = None, layers: int = 1) -> DataFrame:
    """What fn makes of the dense fields of frames; the records of a frame meet in one task, nothing is exploded.

    fn(ids, dx, dy) gets frame numbers [n] and fields [layers, n, grid_h, grid_w], NaN where no block lies, and
    returns the columns of `schema` as arrays.  Blocks stand around their dst point, half open and cut to
    the grid, and are painted in record order, the last one stays.  `layer` tells the field of a record.
    Records with a null frame_id, mv_idx, place, size or motion paint nothing; a frame with no others is absent.
    """
    own = _geometry(mvs.withColumn("layer", (F.lit(0) if layer is None else layer).cast("int"))).where(f"layer >= 0 and layer < {layers}")
    own = dealt(own.select("frame_id", "mv_idx", "dst_x", "dst_y", "w", "h", "layer", "dx", "dy"))
    names = [f.split()[0] for f in schema.split(", ")]

    def fields(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        frame, _, cx, cy, w, h, z, dx, dy, turn = (rows.column(c).to_numpy() for c in own_columns)
        x0, y0 = cx - w // 2, cy - h // 2
        ids, at = np.unique(frame, return_inverse=True)  # frames come in order
        most = max(1, FIELD_BYTES // (16 * layers * grid_h * grid_w))
        for lo in range(0, len(ids), most):
            n = min(most, len(ids) - lo)
            out = np.full((2, layers, n, grid_h, grid_w), np.nan)
            s = slice(*np.searchsorted(at, (lo, lo + n)))
            # the k-th records of all frames lie in different fields, so those of one size are laid at once
            order = np.lexsort((h[s], w[s], turn[s]))
            new = np.ones(len(order), bool)
            for v in (turn[s], w[s], h[s]):
                new[1:] &= v[order][1:] == v[order][:-1]
            new[1:] = ~new[1:]
            starts = np.append(np.flatnonzero(new), len(order))
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                r = order[i:j] + s.start
                y, x = y0[r, None] + np.arange(h[r[0]]), x0[r, None] + np.arange(w[r[0]])
                rows, ys, xs = np.nonzero(((y >= 0) & (y < grid_h))[:, :, None] & ((x >= 0) & (x < grid_w))[:, None, :])
                place = (z[r[rows]], at[r[rows]] - lo, y[rows, ys], x[rows, xs])
                out[0][place], out[1][place] = dx[r[rows]], dy[r[rows]]
            cols = fn(ids[lo : lo + n], out[0], out[1])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    own_columns = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(batches, ["frame_id"]):
            yield from fields(rows)

    return own.mapInArrow(run, schema)


def covered_centres(mvs: DataFrame, paints: Column, grid_w: int, grid_h: int, keep: list[str]) -> DataFrame:
    """Columns `keep` of all records with y, x (the block's centre, held inside the grid) and covered: whether a record of the frame for which
    `paints` holds lies there.

    The records of a frame meet in one task and give a row each; no cell leaves it.  A record without a frame or place is covered by none."""
    used = ["dst_x", "dst_y", "w", "h", "motion_x", "motion_y"]
    centre = [F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int").alias(a) for a, c, n in (("y", "dst_y", grid_h), ("x", "dst_x", grid_w))]
    mark = paints
    for c in ("mv_idx", *used):
        mark = mark & F.col(c).isNotNull()
    own = mvs.select(*keep, *centre, (F.col("dst_x").isNotNull() & F.col("dst_y").isNotNull() & F.col("frame_id").isNotNull()).alias("covered"), F.coalesce(mark, F.lit(False)).alias("__paints"), F.col("frame_id").alias("__frame"), F.col("mv_idx").alias("__idx"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"__{c}") for c in used[:4]])
    rest = own.where("__frame is null").select(*keep, "y", "x", "covered")
    own = own.where("__frame is not null").withColumn("__turn", F.row_number().over(Window.partitionBy("__frame").orderBy("__idx")))
    names, schema = rest.columns, rest.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["__frame"]):
            cx, cy, w, h, y, x, placed, marked = (rows.column(c).to_numpy() for c in ("__dst_x", "__dst_y", "__w", "__h", "y", "x", "covered", "__paints"))
            most = max(1, FIELD_BYTES // (32 * grid_h * -(-grid_w // 64)))
            ends = np.append(starts, rows.num_rows)
            hit = np.zeros(rows.num_rows, bool)
            for lo in range(0, len(starts), most):
                n = min(most, len(starts) - lo)
                s = slice(int(ends[lo]), int(ends[lo + n]))
                at = np.repeat(np.arange(n), np.diff(ends[lo : lo + n + 1]))
                p = np.flatnonzero(marked[s]) + s.start
                seen = np.zeros((n, grid_h, -(-grid_w // 64)), np.uint64)
                own_at = at[p - s.start]
                for r, cells in bits.laid(own_at, cx[p] - w[p] // 2, cy[p] - h[p] // 2, w[p], h[p], n, grid_w, grid_h):
                    seen[own_at[r]] |= cells
                hit[s] = (seen[at, y[s], x[s] // 64] >> (x[s] % 64).astype(np.uint64)) & np.uint64(1) > 0
            yield pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in (*keep, "y", "x")), pa.array(hit & placed)], names)

    return own.mapInArrow(run, schema).unionByName(rest)


def rasterised(mvs: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """frame_id, y, x, dx, dy: the covered cells of each frame's field."""

    def cells(ids, dx, dy):
        k, y, x = np.nonzero(np.isfinite(dx[0]))
        return ids[k], y.astype(np.int32), x.astype(np.int32), dx[0][k, y, x], dy[0][k, y, x]

    return painted(mvs, grid_w, grid_h, cells, "frame_id long, y int, x int, dx double, dy double")


def field_sums(mvs: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame: covered cells and the sums of dx, dy and of the magnitude over them; frames without a covered cell are absent."""

    def sums(ids, dx, dy):
        n = np.isfinite(dx[0]).sum((1, 2))
        own = n > 0
        total = lambda v: np.nansum(v, axis=(1, 2))[own]
        return ids[own], n[own], total(dx[0]), total(dy[0]), total(np.hypot(dx[0], dy[0]))

    return painted(mvs, grid_w, grid_h, sums, "frame_id long, cells long, dx_sum double, dy_sum double, mag_sum double")


def motion_signal(mvs: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame: covered cells, mean magnitude over them, share of cells without a vector."""
    n = F.col("cells")
    return field_sums(mvs, grid_w, grid_h).select("frame_id", n.alias("covered"), (F.col("mag_sum") / n).alias("mag_mean"), (1.0 - n / F.lit(grid_w * grid_h)).alias("intra"))


def layer_overlap(mvs: DataFrame, layer: Column, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame: cells that both layers (0 and 1) cover, only the first, only the second, and neither."""

    def overlap(ids, dx, dy):
        a, b = np.isfinite(dx)
        both, only_a, only_b = (m.sum((1, 2)) for m in (a & b, a & ~b, b & ~a))
        own = both + only_a + only_b > 0
        return ids[own], both[own], only_a[own], only_b[own], (grid_w * grid_h - both - only_a - only_b)[own]

    return painted(mvs, grid_w, grid_h, overlap, "frame_id long, both long, first_only long, second_only long, neither long", layer, 2)


def fast_boxes(mvs: DataFrame, least: float, pad: int, grid_w: int, grid_h: int) -> DataFrame:
    """Smallest box (half open) around the cells of each frame that move by `least` or more, padded and cut to the grid; frames without one are absent."""

    def boxes(ids, dx, dy):
        fast = dx[0] ** 2 + dy[0] ** 2 >= least * least  # NaN is not
        xs, ys = fast.any(1), fast.any(2)
        own = xs.any(1)
        ends = [(v[own].argmax(1), v.shape[1] - v[own][:, ::-1].argmax(1), most) for v, most in ((xs, grid_w), (ys, grid_h))]
        return ids[own], *(v.astype(np.int32) for a, b, most in ends for v in (np.maximum(a - pad, 0), np.minimum(b + pad, most)))

    return painted(mvs, grid_w, grid_h, boxes, "frame_id long, x0 int, x1 int, y0 int, y1 int")


def _tiled(mvs: DataFrame, sizes: list[int], grid_w: int, grid_h: int, fn: Callable, schema: str) -> DataFrame:
    """What fn makes of the tiles of frames: fn(ids, size, cells, most) gets frame numbers [n], covered cells and the largest squared magnitude
    [n, rows, columns] of the tiles of one size, and returns the columns of `schema` as arrays.

    Cells are bits, last records first, so no field of numbers is painted; the records of a frame meet in one task."""
    own = dealt(_geometry(mvs).select("frame_id", "mv_idx", "dst_x", "dst_y", "w", "h", "dx", "dy"))
    names = [f.split()[0] for f in schema.split(", ")]
    words = -(-grid_w // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(s, bits.Tiles(s, grid_w, grid_h)) for s in sizes]
        per_frame = 32 * grid_h * words + 16 * sum(t.shape[0] * t.shape[1] for _, t in tiles) + 16 * grid_h * max(t.shape[1] for _, t in tiles) * words
        step = max(1, FIELD_BYTES // per_frame)
        for rows, starts in whole_groups(batches, ["frame_id"]):
            frame, cx, cy, w, h, dx, dy = (rows.column(c).to_numpy() for c in ("frame_id", "dst_x", "dst_y", "w", "h", "dx", "dy"))
            mag, ends = dx**2 + dy**2, np.append(starts, rows.num_rows)
            for lo in range(0, len(starts), step):
                n = min(step, len(starts) - lo)
                s = slice(int(ends[lo]), int(ends[lo + n]))
                at = np.repeat(np.arange(n), np.diff(ends[lo : lo + n + 1]))
                seen, most = np.zeros((n, grid_h, words), np.uint64), [np.full((n, *t.shape), -1.0) for _, t in tiles]
                for r, cells in bits.laid(at, (cx - w // 2)[s], (cy - h // 2)[s], w[s], h[s], n, grid_w, grid_h):
                    own_mag = mag[s][r]
                    cells[~np.isfinite(own_mag)] = 0
                    seen[at[r]] |= cells
                    for (_, t), m in zip(tiles, most, strict=True):
                        m[at[r]] = np.maximum(m[at[r]], np.where(t.touched(cells), own_mag[:, None, None], -1.0))
                for (size, t), m in zip(tiles, most, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in fn(frame[ends[lo : lo + n]], size, t.counts(seen), m)], names)

    return own.mapInArrow(run, schema)


def tile_sums(mvs: DataFrame, sizes: list[int], grid_w: int, grid_h: int) -> DataFrame:
    """frame_id, size, ty, tx, cells and the largest squared magnitude of each size x size tile of each frame that has a covered cell."""

    def told(ids, size, cells, most):
        k, ty, tx = np.nonzero(cells)
        return ids[k], np.full(len(k), size, np.int32), ty.astype(np.int32), tx.astype(np.int32), cells[k, ty, tx], most[k, ty, tx]

    return _tiled(mvs, sizes, grid_w, grid_h, told, "frame_id long, size int, ty int, tx int, cells long, most double")


def tile_shares(mvs: DataFrame, sizes: list[int], eps: float, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame and size of tiles: how many have a covered cell, and the share of these whose largest squared magnitude is above eps; frames without any are absent."""

    def told(ids, size, cells, most):
        n, fast = (cells > 0).sum((1, 2)), (most > eps).sum((1, 2))
        own = n > 0
        return ids[own], np.full(own.sum(), size, np.int32), n[own], fast[own] / n[own]

    return _tiled(mvs, sizes, grid_w, grid_h, told, "frame_id long, size int, tiles long, share double")


def fullest_tiles(mvs: DataFrame, size: int, tenths: int, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame: tiles that have a covered cell, and how many of the fullest hold `tenths` tenths of the covered cells; frames without any are absent."""

    def told(ids, size, cells, most):
        n = np.sort(cells.reshape(len(ids), -1), axis=1)[:, ::-1].cumsum(1)
        own = n[:, -1] > 0
        enough = 10 * n >= tenths * n[:, -1:]
        return ids[own], (cells > 0).sum((1, 2))[own], (enough.argmax(1) + 1).astype(np.int32)[own]

    return _tiled(mvs, [size], grid_w, grid_h, told, "frame_id long, touched long, needed int")


def mask_regions(mvs: DataFrame, least: float, grid_w: int, grid_h: int) -> DataFrame:
    """Per frame: regions (joined by sides or corners) of the cells that move by `least` or more, share of the largest one, and cells over the
    area of the regions' boxes; frames without such a cell have zeros."""

    def told(ids, dx, dy):
        return ids, *regions.Runs(dx[0] ** 2 + dy[0] ** 2 >= least * least).by_frame()

    return painted(mvs, grid_w, grid_h, told, "frame_id long, regions long, largest double, fill double")


def camera_verdict(mvs: DataFrame, clip: Column, static: float = 0.6, least: int = 1) -> DataFrame:
    """Per clip: median over frames of the length of the frame's median vector, and STATIC, MOVING or UNKNOWN."""
    frame = projected(mvs).groupBy(clip.alias("clip"), "frame_id").agg(F.median("dx").alias("mx"), F.median("dy").alias("my"))
    n = frame.groupBy("clip").agg(F.count(F.lit(1)).alias("n_frames"))
    # a frame's records are few, a clip's frames are not
    middle = medians(frame, ["clip"], F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")), "camera_px", 0.125).drop("n")
    out = n.join(middle, "clip", "left")
    verdict = F.when(F.col("n_frames") < least, "UNKNOWN").when(F.col("camera_px") < static, "STATIC").otherwise("MOVING")
    return out.withColumn("verdict", verdict)


def motion_map(mvs: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """y, x, mean_mag of every cell of the grid over the frames that cover it, n of them; 0 where none does.

    Tasks give sums over runs of frames, so a row a cell and run is shuffled."""

    def sums(ids, dx, dy):
        mag = np.hypot(dx[0], dy[0])
        n = np.isfinite(mag).sum(0).ravel()
        some = np.flatnonzero(n)
        return some, np.nansum(mag, axis=0).ravel()[some], n[some]

    seen = painted(mvs, grid_w, grid_h, sums, "cell long, s double, k long").groupBy("cell").agg((F.sum("s") / F.sum("k")).alias("m"), F.sum("k").alias("n"))
    grid = mvs.sparkSession.range(grid_w * grid_h).withColumnRenamed("id", "cell")
    both = grid.join(F.broadcast(seen), "cell", "left")  # grid_w * grid_h rows
    y, x = (F.col("cell") / grid_w).cast("int").alias("y"), (F.col("cell") % grid_w).cast("int").alias("x")
    return both.select(y, x, F.coalesce("m", F.lit(0.0)).alias("mean_mag"), F.coalesce("n", F.lit(0)).alias("n"))


def region_bands(cells: DataFrame, pct_static: float = 40.0, pct_dynamic: float = 75.0) -> DataFrame:
    """static and dynamic masks of a motion map by its percentiles; the dynamic limit stays above the static one."""
    t = cells.agg(F.percentile("mean_mag", pct_static / 100).alias("t_static"), F.percentile("mean_mag", pct_dynamic / 100).alias("t_high"))
    t = t.withColumn("t_dynamic", F.greatest("t_high", F.col("t_static") + 1e-3)).drop("t_high")
    both = cells.crossJoin(F.broadcast(t))  # one row of limits
    return both.withColumn("is_static", F.col("mean_mag") <= F.col("t_static")).withColumn("is_dynamic", F.col("mean_mag") >= F.col("t_dynamic"))
