"""Queries over the mvs view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import motion

W, H = views.GRID_W, views.GRID_H


def mv_project(spark: SparkSession, d: str) -> DataFrame:
    own = motion.projected(motion.direction(views.mvs(spark, d), "past"))
    return own.select("frame_id", "mv_idx", "dx", "dy", "area")


def mv_audit(spark: SparkSession, d: str) -> DataFrame:
    return motion.audit(views.mvs(spark, d))


def _past(spark: SparkSession, d: str) -> DataFrame:
    return motion.direction(views.mvs(spark, d), "past")


def flow_raster(spark: SparkSession, d: str) -> DataFrame:
    """Cells and sums of each frame's dense field; vectors are quarters, so sums are exact."""
    return motion.field_sums(_past(spark, d), W, H).drop("mag_sum")


def motion_signal(spark: SparkSession, d: str) -> DataFrame:
    return motion.motion_signal(_past(spark, d), W, H)


def camera_verdict(spark: SparkSession, d: str) -> DataFrame:
    return motion.camera_verdict(views.mvs(spark, d), (F.col("frame_id") % 50).cast("int"), static=1.5)


def motion_map(spark: SparkSession, d: str) -> DataFrame:
    return motion.motion_map(_past(spark, d), W, H)


def motion_bands(spark: SparkSession, d: str) -> DataFrame:
    out = motion.region_bands(motion.motion_map(_past(spark, d), W, H))
    return out.select("y", "x", "is_static", "is_dynamic")


def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Per frame: cells that only past, only future, both or no records cover."""
    m = views.mvs(spark, d)
    out = motion.layer_overlap(m, F.when(F.col("source") < 0, 0).when(F.col("source") > 0, 1), W, H)
    return out.withColumnsRenamed({"first_only": "past_only", "second_only": "future_only"})


def fast_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the cells of each frame that move by 3 pixels or more: how many, the largest one's share, and how full their boxes are."""
    return motion.mask_regions(_past(spark, d), 3.0, W, H)


def fast_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Box around the cells of each frame that move by 5 pixels or more, padded by 2."""
    return motion.fast_boxes(_past(spark, d), 5.0, 2, W, H)


def tile_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Per frame: 8x8 grid tiles that covered cells touch, and how many of the fullest hold nine tenths of them."""
    return motion.fullest_tiles(_past(spark, d), 8, 9, W, H).withColumnRenamed("needed", "for_90")


RASTER = f"""WITH {views.MVS},
b AS (
  SELECT *, motion_x / 4.0 AS dx, motion_y / 4.0 AS dy,
    greatest(dst_x - w // 2, 0) AS x0, least(dst_x - w // 2 + w, 64) AS x1, greatest(dst_y - h // 2, 0) AS y0, least(dst_y - h // 2 + h, 32) AS y1 FROM mvs),
c AS (SELECT frame_id, source, mv_idx, dx, dy, y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM b)),
flow AS (
  SELECT frame_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, arg_max(dx, mv_idx)::DOUBLE AS dx, arg_max(dy, mv_idx)::DOUBLE AS dy
  FROM c WHERE source < 0 GROUP BY frame_id, y, x)
"""

QUERIES = {
    "mv_project": mv_project, "mv_audit": mv_audit, "flow_raster": flow_raster, "motion_signal": motion_signal, "camera_verdict": camera_verdict, "motion_map": motion_map,
    "motion_bands": motion_bands, "mask_algebra": mask_algebra, "fast_boxes": fast_boxes, "fast_regions": fast_regions, "tile_clusters": tile_clusters,
}

ORACLE_SQL = {
    "mv_project": f"WITH {views.MVS} SELECT frame_id, mv_idx, motion_x / 4.0::DOUBLE AS dx, motion_y / 4.0::DOUBLE AS dy, w * h AS area FROM mvs WHERE source < 0",
    "mv_audit": f"""WITH {views.MVS} SELECT frame_id, count(*) AS nmv, count(*) FILTER (WHERE source < 0) AS n_past, count(*) FILTER (WHERE source > 0) AS n_future,
  max(abs(source)) AS max_source, count(*) FILTER (WHERE abs(source) > 1) AS n_far FROM mvs GROUP BY frame_id""",
    "flow_raster": RASTER + "SELECT frame_id, count(*) AS cells, sum(dx) AS dx_sum, sum(dy) AS dy_sum FROM flow GROUP BY frame_id",
    "motion_signal": RASTER + "SELECT frame_id, count(*) AS covered, avg(sqrt(dx * dx + dy * dy)) AS mag_mean, 1.0 - count(*) / 2048.0::DOUBLE AS intra FROM flow GROUP BY frame_id",
    "camera_verdict": f"""WITH {views.MVS}, f AS (SELECT CAST(frame_id % 50 AS INTEGER) AS clip, frame_id, median(motion_x / 4.0::DOUBLE) AS mx, median(motion_y / 4.0::DOUBLE) AS my FROM mvs GROUP BY ALL),
c AS (SELECT clip, count(*) AS n_frames, median(sqrt(mx * mx + my * my)) AS camera_px FROM f GROUP BY clip)
SELECT *, CASE WHEN camera_px < 1.5 THEN 'STATIC' ELSE 'MOVING' END AS verdict FROM c""",
    "motion_map": RASTER + """, s AS (SELECT y, x, avg(sqrt(dx * dx + dy * dy)) AS m, count(*) AS n FROM flow GROUP BY y, x), g AS (SELECT CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x FROM range(2048) t(i))
SELECT y, x, coalesce(m, 0) AS mean_mag, coalesce(n, 0) AS n FROM g LEFT JOIN s USING (y, x)""",
    "motion_bands": RASTER + """, s AS (SELECT y, x, avg(sqrt(dx * dx + dy * dy)) AS m FROM flow GROUP BY y, x), g AS (SELECT CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x FROM range(2048) t(i)),
k AS (SELECT y, x, coalesce(m, 0) AS m FROM g LEFT JOIN s USING (y, x)), t AS (SELECT quantile_cont(m, 0.4) AS lo, greatest(quantile_cont(m, 0.75), quantile_cont(m, 0.4) + 0.001) AS hi FROM k)
SELECT y, x, m <= lo AS is_static, m >= hi AS is_dynamic FROM k, t""",
    "mask_algebra": RASTER + """, p AS (SELECT DISTINCT frame_id, y, x FROM c WHERE source < 0), q AS (SELECT DISTINCT frame_id, y, x FROM c WHERE source > 0),
j AS (SELECT coalesce(p.frame_id, q.frame_id) AS frame_id, p.frame_id IS NOT NULL AS a, q.frame_id IS NOT NULL AS b FROM p FULL JOIN q ON p.frame_id = q.frame_id AND p.y = q.y AND p.x = q.x)
SELECT frame_id, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS past_only, count(*) FILTER (WHERE b AND NOT a) AS future_only, 2048 - count(*) AS neither FROM j GROUP BY frame_id""",
    "fast_boxes": RASTER + "SELECT frame_id, greatest(min(x) - 2, 0) AS x0, least(max(x) + 3, 64) AS x1, greatest(min(y) - 2, 0) AS y0, least(max(y) + 3, 32) AS y1 FROM flow WHERE dx * dx + dy * dy >= 25 GROUP BY frame_id",
    "tile_clusters": RASTER + """, t AS (SELECT frame_id, y // 8 AS ty, x // 8 AS tx, count(*) AS c FROM flow GROUP BY ALL),
r AS (SELECT *, sum(c) OVER w AS upto, row_number() OVER w AS k, sum(c) OVER (PARTITION BY frame_id) AS every FROM t WINDOW w AS (PARTITION BY frame_id ORDER BY c DESC, ty, tx ROWS UNBOUNDED PRECEDING))
SELECT frame_id, count(*) AS touched, min(CASE WHEN upto >= 0.9 * every THEN k END) AS for_90 FROM r GROUP BY frame_id""",
}
