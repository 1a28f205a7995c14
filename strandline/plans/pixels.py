"""Queries over the tiles view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..operators import tiles as ops

GATE = "(frame_idx + pos) % 3 <> 0"


def plate_median(spark: SparkSession, d: str) -> DataFrame:
    return ops.plate_median(views.tiles(spark, d), F.expr(GATE), min_samples=3)


def plate_coverage(spark: SparkSession, d: str) -> DataFrame:
    return ops.coverage_report(plate_median(spark, d))


def tile_psnr(spark: SparkSession, d: str) -> DataFrame:
    """PSNR of each tile against its scene's plate."""
    t = views.tiles(spark, d)
    plate = plate_median(spark, d).select("scene", "pos", "value")
    both = t.join(plate, ["scene", "pos"])
    diff = F.col("luma") - F.col("value")
    return both.groupBy("scene", "frame_idx").agg(F.avg(diff * diff).alias("mse")).withColumn("psnr", ops.psnr_of(F.col("mse")))


def tile_delta(spark: SparkSession, d: str) -> DataFrame:
    return ops.temporal_change(views.tiles(spark, d), F.col("pos") % 2 == 0)


def alpha_union(spark: SparkSession, d: str) -> DataFrame:
    return ops.union_mask(views.tiles(spark, d), F.col("luma") / 255.0)


def tile_blend(spark: SparkSession, d: str) -> DataFrame:
    """Each tile blended with its scene's plate, and laid over it."""
    both = views.tiles(spark, d).join(plate_median(spark, d).select("scene", "pos", "plate"), ["scene", "pos"])
    alpha = (F.col("pos") % 5) / 4.0
    return both.select(
        "scene", "frame_idx", "pos", ops.blended(F.col("plate").cast("double"), F.floor("luma").cast("double"), 0.75).cast("int").alias("blend"),
        ops.composed(F.floor("luma").cast("double"), F.col("plate").cast("double"), alpha).alias("composite"),
    )


def tile_downscale(spark: SparkSession, d: str) -> DataFrame:
    return ops.downscaled(views.tiles(spark, d), 2)


def frame_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = views.mvs(spark, d).where("mv_idx = 0")
    return m.select(F.col("frame_id").alias("frame_idx"), (F.col("motion_x") / 8.0).alias("dx"), (F.col("motion_y") / 4.0).alias("dy"))


def tile_warp(spark: SparkSession, d: str) -> DataFrame:
    return ops.warped(views.tiles(spark, d), frame_vectors(spark, d))


def tile_splat(spark: SparkSession, d: str) -> DataFrame:
    return ops.splatted(views.tiles(spark, d), frame_vectors(spark, d), F.col("luma") / 64.0)


def tile_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return ops.var_laplacian(views.tiles(spark, d))


def tile_blockiness(spark: SparkSession, d: str) -> DataFrame:
    return ops.blockiness(views.tiles(spark, d))


def matte_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each tile as a matte against its scene's union: mean |difference|, overlap of the halves, foreground share."""
    t = views.tiles(spark, d).select("scene", "frame_idx", "pos", (F.col("luma") / 255.0).alias("p"))
    g = ops.plate_median(views.tiles(spark, d), F.expr(GATE)).select("scene", "pos", (F.col("value") / 255.0).alias("g"))
    both = t.join(g, ["scene", "pos"])
    a, b = F.col("p") >= 0.5, F.col("g") >= 0.5
    out = both.groupBy("scene", "frame_idx").agg(
        F.avg(F.abs(F.col("p") - F.col("g"))).alias("mad"), F.count_if(a & b).alias("common"), F.count_if(a | b).alias("any"), F.avg(a.cast("double")).alias("foreground")
    )
    return out.withColumn("iou", F.coalesce(F.try_divide("common", "any"), F.lit(1.0))).drop("common", "any")


def edge_flicker(spark: SparkSession, d: str) -> DataFrame:
    """Mean |change| of a matte, overall and where either alpha lies in (0.05, 0.95)."""
    t = views.tiles(spark, d).withColumn("alpha", F.col("luma") / 255.0)
    prev = F.lag("alpha").over(Window.partitionBy("scene", "pos").orderBy("frame_idx"))
    t = t.withColumn("before", prev).where("before is not null").withColumn("c", F.abs(F.col("alpha") - F.col("before")))
    band = lambda x: (F.col(x) > 0.05) & (F.col(x) < 0.95)
    return t.groupBy("scene", "frame_idx").agg(F.avg("c").alias("flicker"), F.coalesce(F.avg(F.when(band("alpha") | band("before"), F.col("c"))), F.lit(0.0)).alias("edge_flicker"))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each tile's whole levels, and of each scene's tiles in display order: of runs of 4,096 frame numbers, then of the runs, so no group grows with a scene's planes."""
    t = views.tiles(spark, d).groupBy("scene", "frame_idx").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.floor("luma").alias("v")))), lambda x: x["v"].cast("string")), ",")).alias("digest"))
    joined = lambda at: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, "digest"))), lambda x: x["digest"]), ""))
    runs = t.groupBy("scene", F.floor(F.col("frame_idx") / 4096).alias("run")).agg(F.count(F.lit(1)).alias("n"), joined("frame_idx").alias("digest"))
    return runs.groupBy("scene").agg(F.sum("n").alias("n"), joined("run").alias("digest"))


PLATE = f"""WITH {views.TILES},
m AS (SELECT scene, pos, median(luma) FILTER (WHERE {GATE}) AS m, count(*) FILTER (WHERE {GATE}) AS coverage, median(luma) AS every FROM tiles GROUP BY scene, pos),
plate AS (SELECT scene, pos, CASE WHEN coverage < {{least}} THEN every ELSE m END AS value, coverage, coverage < {{least}} AS hole FROM m)
"""
P3, P1 = PLATE.format(least=3), PLATE.format(least=1)
VECTORS = f"""v AS (SELECT frame_id AS frame_idx, motion_x / 8.0::DOUBLE AS dx, motion_y / 4.0::DOUBLE AS dy FROM mvs WHERE mv_idx = 0)"""

QUERIES = {
    "plate_median": plate_median, "plate_coverage": plate_coverage, "tile_psnr": tile_psnr, "tile_delta": tile_delta, "alpha_union": alpha_union, "tile_blend": tile_blend,
    "tile_downscale": tile_downscale, "tile_warp": tile_warp, "tile_splat": tile_splat, "tile_sharpness": tile_sharpness, "tile_blockiness": tile_blockiness,
    "matte_agreement": matte_agreement, "edge_flicker": edge_flicker, "fingerprints": fingerprints,
}

ORACLE_SQL = {
    "plate_median": P3 + "SELECT scene, pos, value, coverage, hole, CAST(trunc(value) AS INTEGER) AS plate FROM plate",
    "plate_coverage": P3 + """SELECT scene, 100.0 * avg((coverage >= 1)::INT) AS pct_1, 100.0 * avg((coverage >= 3)::INT) AS pct_3, 100.0 * avg((coverage >= 5)::INT) AS pct_5,
  100.0 * avg(hole::INT) AS pct_hole, max(coverage) AS most, median(coverage) AS middle FROM plate GROUP BY scene""",
    "tile_psnr": P3 + """, e AS (SELECT t.scene, t.frame_idx, avg((t.luma - p.value) * (t.luma - p.value)) AS mse FROM tiles t JOIN plate p USING (scene, pos) GROUP BY t.scene, t.frame_idx)
SELECT *, CASE WHEN mse <= 1e-12 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0 / mse) END AS psnr FROM e""",
    "tile_delta": f"""WITH {views.TILES}, c AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY scene, pos ORDER BY frame_idx)) AS ch FROM tiles)
SELECT scene, frame_idx, avg(ch) FILTER (WHERE pos % 2 = 0) AS change, count(ch) FILTER (WHERE pos % 2 = 0) AS n FROM c GROUP BY scene, frame_idx""",
    "alpha_union": f"WITH {views.TILES} SELECT scene, pos, max(luma / 255.0) AS alpha FROM tiles GROUP BY scene, pos",
    "tile_blend": P3 + """SELECT t.scene, t.frame_idx, t.pos,
  CAST(least(greatest(round_even(trunc(p.value) + 0.75::DOUBLE * (floor(t.luma) - trunc(p.value)), 0), 0), 255) AS INTEGER) AS blend,
  CAST(trunc((t.pos % 5) / 4.0::DOUBLE * floor(t.luma) + (1.0::DOUBLE - (t.pos % 5) / 4.0::DOUBLE) * trunc(p.value)) AS INTEGER) AS composite
FROM tiles t JOIN plate p USING (scene, pos)""",
    "tile_downscale": f"WITH {views.TILES} SELECT scene, frame_idx, CAST((pos // 16) * 4 + (pos % 8) // 2 AS INTEGER) AS cell, avg(luma) AS luma FROM tiles GROUP BY ALL",
    "tile_warp": f"""WITH {views.TILES}, {views.MVS}, {VECTORS},
s AS (SELECT t.scene, t.frame_idx, t.pos, least(greatest(t.pos % 8 + coalesce(v.dx, 0), 0), 7) AS sx, least(greatest(t.pos // 8 + coalesce(v.dy, 0), 0), 7) AS sy FROM tiles t LEFT JOIN v USING (frame_idx)),
q AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s),
k AS (SELECT *, unnest([0, 1, 0, 1]) AS ox, unnest([0, 0, 1, 1]) AS oy FROM q),
w AS (SELECT scene, frame_idx, pos, CAST(least(y0 + oy, 7) * 8 + least(x0 + ox, 7) AS INTEGER) AS at, (CASE WHEN ox = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN oy = 1 THEN fy ELSE 1 - fy END) AS weight FROM k)
SELECT w.scene, w.frame_idx, w.pos, sum(w.weight * t.luma) AS luma FROM w JOIN tiles t ON t.scene = w.scene AND t.frame_idx = w.frame_idx AND t.pos = w.at GROUP BY ALL""",
    "tile_splat": f"""WITH {views.TILES}, {views.MVS}, {VECTORS},
s AS (SELECT t.*, t.pos % 8 + coalesce(v.dx, 0) AS sx, t.pos // 8 + coalesce(v.dy, 0) AS sy, exp(t.luma / 64.0 - max(t.luma / 64.0) OVER (PARTITION BY t.scene, t.frame_idx)) AS e FROM tiles t LEFT JOIN v USING (frame_idx)),
k AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy, unnest([0, 1, 0, 1]) AS ox, unnest([0, 0, 1, 1]) AS oy FROM s),
w AS (SELECT scene, frame_idx, luma, e, x0 + ox AS x, y0 + oy AS y, (CASE WHEN ox = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN oy = 1 THEN fy ELSE 1 - fy END) AS share FROM k)
SELECT scene, frame_idx, CAST(y * 8 + x AS INTEGER) AS pos, sum(share * e * luma) / sum(share * e) AS luma FROM w WHERE x >= 0 AND x < 8 AND y >= 0 AND y < 8 AND share > 0 GROUP BY ALL""",
    "tile_sharpness": f"""WITH {views.TILES}, l AS (SELECT *, lag(luma) OVER w + lead(luma) OVER w + lag(luma, 8) OVER w + lead(luma, 8) OVER w - 4 * luma AS lap FROM tiles WINDOW w AS (PARTITION BY scene, frame_idx ORDER BY pos))
SELECT scene, frame_idx, var_pop(lap) FILTER (WHERE pos % 8 BETWEEN 1 AND 6 AND pos // 8 BETWEEN 1 AND 6) AS sharpness FROM l GROUP BY ALL""",
    "tile_blockiness": f"""WITH {views.TILES}, s AS (SELECT *, abs(lead(luma) OVER (PARTITION BY scene, frame_idx, pos // 8 ORDER BY pos) - luma) AS step FROM tiles)
SELECT scene, frame_idx, avg(step) FILTER (WHERE (pos % 8) % 4 = 3) / (avg(step) + 1e-6) AS blockiness FROM s GROUP BY ALL""",
    "matte_agreement": P1 + """, b AS (SELECT t.scene, t.frame_idx, t.luma / 255.0 AS p, q.value / 255.0 AS g FROM tiles t JOIN plate q USING (scene, pos))
SELECT scene, frame_idx, avg(abs(p - g)) AS mad, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS foreground,
  coalesce(count(*) FILTER (WHERE p >= 0.5 AND g >= 0.5) / CAST(nullif(count(*) FILTER (WHERE p >= 0.5 OR g >= 0.5), 0) AS DOUBLE), 1.0) AS iou FROM b GROUP BY ALL""",
    "edge_flicker": f"""WITH {views.TILES}, a AS (SELECT scene, frame_idx, pos, luma / 255.0 AS alpha, lag(luma / 255.0) OVER (PARTITION BY scene, pos ORDER BY frame_idx) AS bef FROM tiles)
SELECT scene, frame_idx, avg(abs(alpha - bef)) AS flicker, coalesce(avg(abs(alpha - bef)) FILTER (WHERE (alpha > 0.05 AND alpha < 0.95) OR (bef > 0.05 AND bef < 0.95)), 0) AS edge_flicker
FROM a WHERE bef IS NOT NULL GROUP BY ALL""",
    "fingerprints": f"""WITH {views.TILES}, t AS (SELECT scene, frame_idx, md5(string_agg(CAST(CAST(floor(luma) AS INTEGER) AS VARCHAR), ',' ORDER BY pos)) AS digest FROM tiles GROUP BY ALL),
r AS (SELECT scene, frame_idx // 4096 AS run, count(*) AS n, md5(string_agg(digest, '' ORDER BY frame_idx)) AS digest FROM t GROUP BY ALL)
SELECT scene, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(digest, '' ORDER BY run)) AS digest FROM r GROUP BY scene""",
}
