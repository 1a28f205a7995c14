"""Queries over the frames view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..operators import refs, routing, segment, stats

CUTS = f"""WITH RECURSIVE {views.FRAMES},
n AS MATERIALIZED (SELECT * FROM frames),
f AS (
  SELECT clip_id, frame_idx, ptype, luma, luma AS prev, CAST(NULL AS DOUBLE) AS base, frame_idx AS last, CAST(NULL AS DOUBLE) AS diff, false AS is_cut
  FROM n WHERE frame_idx = 0
  UNION ALL
  SELECT clip_id, frame_idx, ptype, luma, luma,
    CASE WHEN cut THEN NULL WHEN base IS NULL THEN d ELSE 0.3::DOUBLE * d + (1.0::DOUBLE - 0.3::DOUBLE) * base END,
    CASE WHEN cut THEN frame_idx ELSE last END, d, cut
  FROM (
    SELECT n.clip_id, n.frame_idx, n.ptype, n.luma, f.base, f.last, abs(n.luma - f.prev) AS d,
      (abs(n.luma - f.prev) > 60 OR (n.ptype = 'I' AND abs(n.luma - f.prev) > 45)
       OR (f.base IS NOT NULL AND abs(n.luma - f.prev) > 40 AND abs(n.luma - f.prev) > 8 * f.base)) AND n.frame_idx - f.last >= 24 AS cut
    FROM f JOIN n ON n.clip_id = f.clip_id AND n.frame_idx = f.frame_idx + 1)),
scened AS (SELECT *, CAST(sum(CAST(is_cut AS INTEGER)) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS INTEGER) AS scene FROM f),
raw AS (SELECT clip_id, scene, min(frame_idx) AS s0, max(frame_idx) + 1 AS s1 FROM scened GROUP BY ALL),
numbered AS (SELECT *, CAST(sum(CASE WHEN scene = 0 OR s1 - s0 >= 24 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY s0) - 1 AS INTEGER) AS sid FROM raw),
segs AS (SELECT clip_id, sid, min(s0) AS s0, max(s1) AS s1 FROM numbered GROUP BY ALL)
"""


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return segment.scene_cuts(views.frames(spark, d))


def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).where("is_cut").select("clip_id", "frame_idx", "diff", "ptype")


def scene_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_cuts(spark, d))


def scene_report(spark: SparkSession, d: str) -> DataFrame:
    cut = _cuts(spark, d)
    held = segment.scene_of(cut, segment.segments(cut))
    return held.groupBy("clip_id", "sid").agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.max("diff").alias("max_diff"), F.avg((F.col("ptype") == "I").cast("double")).alias("i_share")
    )


def frame_scene(spark: SparkSession, d: str) -> DataFrame:
    cut = _cuts(spark, d)
    return segment.scene_of(cut, segment.segments(cut)).select("clip_id", "frame_idx", "sid")


def gop_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.gop_chunks(_cuts(spark, d), soft_cap=12).select("clip_id", "frame_idx", "chunk_id", "place")


CHUNKS = CUTS + """,
c AS (
  SELECT clip_id, frame_idx, 0 AS chunk_id, 1 AS held FROM f WHERE frame_idx = 0
  UNION ALL
  SELECT clip_id, frame_idx, CASE WHEN new THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN new THEN 1 ELSE held + 1 END
  FROM (SELECT f.clip_id, f.frame_idx, c.chunk_id, c.held, (f.ptype = 'I' OR f.is_cut OR (c.held >= 12 AND f.ptype = 'P')) AS new
        FROM c JOIN (SELECT * FROM f) f ON f.clip_id = c.clip_id AND f.frame_idx = c.frame_idx + 1))
SELECT clip_id, frame_idx, chunk_id, held - 1 AS place FROM c
"""


def ptype_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = segment.islands(views.frames(spark, d), "ptype")
    return runs.groupBy("clip_id", "run", "ptype").agg(F.min("frame_idx").alias("lo"), F.count(F.lit(1)).alias("n"))


def ref_links(spark: SparkSession, d: str) -> DataFrame:
    return refs.reference_links(views.frames(spark, d)).select("clip_id", "frame_idx", "prev_ref", "next_ref", "w_prev", "w_next")


def anchors_forced(spark: SparkSession, d: str) -> DataFrame:
    return refs.forced_anchors(views.frames(spark, d), ["clip_id"], every=4).select("clip_id", "frame_idx", "backbone_pos", "is_anchor")


def drift_distance(spark: SparkSession, d: str) -> DataFrame:
    own = refs.drift_distance(refs.forced_anchors(views.frames(spark, d), ["clip_id"]))
    return own.select("clip_id", "frame_idx", "hops", "shown_distance")


def _with_hole(spark: SparkSession, d: str) -> DataFrame:
    return views.frames(spark, d).withColumn("hole", F.col("luma") / 500.0)


def budget_anchors(spark: SparkSession, d: str) -> DataFrame:
    return refs.budget_anchors(_with_hole(spark, d), "hole", 0.5).where("spent is not null").select("clip_id", "frame_idx", "promoted", "spent")


BUDGET = f"""WITH RECURSIVE {views.FRAMES},
b AS MATERIALIZED (SELECT *, luma / 500.0 AS hole, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM frames WHERE ptype IN ('I', 'P')),
r AS (
  SELECT clip_id, frame_idx, k, false AS promoted, 0.0::DOUBLE AS spent FROM b WHERE k = 1
  UNION ALL
  SELECT b.clip_id, b.frame_idx, b.k, b.ptype <> 'I' AND (CASE WHEN r.promoted THEN 0 ELSE r.spent END) + b.hole >= 0.5,
    CASE WHEN b.ptype = 'I' THEN 0 ELSE (CASE WHEN r.promoted THEN 0 ELSE r.spent END) + b.hole END
  FROM r JOIN b ON b.clip_id = r.clip_id AND b.k = r.k + 1)
SELECT clip_id, frame_idx, promoted, spent FROM r
"""


def ema_signal(spark: SparkSession, d: str) -> DataFrame:
    own = views.frames(spark, d).withColumn("again", F.col("ptype") == "I").withColumn("use", F.col("ptype") != "B")
    return refs.ema(own, "luma", 0.3, "again", "use").select("clip_id", "frame_idx", "ema")


EMA = f"""WITH RECURSIVE {views.FRAMES},
n AS MATERIALIZED (SELECT * FROM frames),
r AS (
  SELECT clip_id, frame_idx, CASE WHEN ptype <> 'B' THEN luma END AS ema FROM n WHERE frame_idx = 0
  UNION ALL
  SELECT n.clip_id, n.frame_idx,
    CASE WHEN n.ptype = 'I' THEN n.luma WHEN n.ptype = 'B' THEN r.ema WHEN r.ema IS NULL THEN n.luma ELSE 0.3::DOUBLE * n.luma + (1.0::DOUBLE - 0.3::DOUBLE) * r.ema END
  FROM r JOIN n ON n.clip_id = r.clip_id AND n.frame_idx = r.frame_idx + 1)
SELECT clip_id, frame_idx, ema FROM r
"""


def luma_diff(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    f = views.frames(spark, d)
    return f.withColumn("diff", F.abs(F.col("luma") - F.lag("luma").over(order))).groupBy("clip_id", "ptype").agg(F.count("diff").alias("n"), F.max("diff").alias("max_diff"), F.min("diff").alias("min_diff"))


def sr_routing(spark: SparkSession, d: str) -> DataFrame:
    own = refs.forced_anchors(_with_hole(spark, d), ["clip_id"])
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    own = own.withColumn("mag", F.coalesce(F.abs(F.col("luma") - F.lag("luma").over(order)) / 100, F.lit(0.0))).withColumn("intra", F.col("luma") / 490)
    limit = routing.fallback_limit(F.col("ptype"), F.col("mag"), F.col("hole"), F.col("intra"), base=0.3, keyed=True)
    own = own.withColumn("limit_at", limit)
    return own.withColumn("route", routing.frame_source(F.col("is_anchor"), refs.on_backbone(), F.col("hole"), F.col("limit_at"))).select("clip_id", "frame_idx", "limit_at", "route")


SR_ROUTING = f"""WITH {views.FRAMES},
s AS (
  SELECT *, luma / 500.0 AS hole, coalesce(abs(luma - lag(luma) OVER w) / 100, 0) AS mag, luma / 490 AS intra,
    ptype = 'I' OR coalesce(frame_idx = min(CASE WHEN ptype IN ('I', 'P') THEN frame_idx END) OVER (PARTITION BY clip_id), false) AS is_anchor
  FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
t AS (SELECT *, CASE WHEN hole > 0.7 AND intra > 0.8 THEN 2.0 WHEN ptype <> 'I' AND mag > 1.0 THEN 0.2 ELSE 0.3 END::DOUBLE AS limit_at FROM s)
SELECT clip_id, frame_idx, limit_at,
  CASE WHEN is_anchor THEN 'anchor' WHEN ptype IN ('I', 'P') AND hole > limit_at THEN 'upgrade' WHEN hole > limit_at THEN 'patch' ELSE 'cheap' END AS route
FROM t
"""


def mode_router(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    f = views.frames(spark, d).withColumn("diff", F.abs(F.col("luma") - F.lag("luma").over(order)))
    s = f.groupBy("clip_id").agg(
        F.avg("luma").alias("a"), F.median("diff").alias("m"), F.max("diff").alias("x"), F.count_if(F.col("ptype") == "I").alias("n_i"), F.max("frame_idx").alias("last")
    )
    s = s.select(
        "clip_id", (F.col("a") / 4).alias("fb_mean"), (F.col("m") / 12).alias("mag_median"), (F.col("n_i") % 3 + 1).alias("n_scenes"), (F.col("x") > 300).alias("hidden_cut"),
        F.when(F.col("clip_id") % 4 == 0, "MOVING").when(F.col("clip_id") % 4 == 1, "UNKNOWN").otherwise("STATIC").alias("verdict"),
        F.when(F.col("clip_id") % 5 == 0, None).otherwise((F.col("last") % 10) / 10).alias("coverage"), (F.col("last") % 25).cast("double").alias("plate_resid"),
    )
    return routing.recommended_mode(s).select("clip_id", "mode", "reason", "matte_unavailable")


MODE = f"""WITH {views.FRAMES},
f AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS diff FROM frames),
s AS (SELECT clip_id, avg(luma) / 4 AS fb, median(diff) / 12 AS mag, count(*) FILTER (WHERE ptype = 'I') % 3 + 1 AS scenes, max(diff) > 300 AS hidden, max(frame_idx) AS last FROM f GROUP BY clip_id),
t AS (SELECT *, CASE clip_id % 4 WHEN 0 THEN 'MOVING' WHEN 1 THEN 'UNKNOWN' ELSE 'STATIC' END AS verdict, CASE WHEN clip_id % 5 = 0 THEN NULL ELSE (last % 10) / 10 END AS cov, last % 25 AS resid FROM s),
u AS (SELECT *, CASE WHEN fb > 50 THEN 'noise' WHEN mag > 10 OR fb > 15 THEN 'high motion or occlusion' WHEN hidden AND scenes = 1 AND mag > 3 THEN 'missed cut'
  WHEN verdict = 'MOVING' OR hidden THEN 'layered unsafe' WHEN cov IS NULL THEN 'matte unavailable' WHEN cov < 0.03 OR cov > 0.85 THEN 'no person in view' WHEN resid > 12 THEN 'background not static' ELSE 'static person' END AS reason FROM t)
SELECT clip_id, CASE WHEN reason IN ('noise', 'high motion or occlusion', 'missed cut', 'background not static') THEN 'quality' WHEN reason = 'static person' THEN 'layered' ELSE 'instant' END AS mode,
  reason, reason = 'matte unavailable' AS matte_unavailable FROM u
"""


def cut_scores(spark: SparkSession, d: str) -> DataFrame:
    cut = _cuts(spark, d)
    found = cut.where("is_cut").select("clip_id", "frame_idx")
    return stats.truth_scores(found, cut.where("ptype = 'I' and diff > 60").select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], ["clip_id"])


def calmest_window(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    return stats.calmest_window(views.frames(spark, d).withColumn("diff", F.abs(F.col("luma") - F.lag("luma").over(order))), "clip_id", 12)


def characterised(spark: SparkSession, d: str) -> DataFrame:
    """One row a clip: signals and the types of its first 48 frames as a string."""
    f = views.frames(spark, d).where("frame_idx < 48")
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "ptype"))), lambda x: x["ptype"]), "")
    return f.groupBy("clip_id").agg(F.max("luma").alias("luma_max"), F.count_if(F.col("ptype") == "I").alias("n_i"), kinds.alias("ptypes"))


def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    """At most 8 evenly spaced frames of each clip."""
    span = views.frames(spark, d).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.when(F.col("n") <= 8, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (k * (F.col("n") / 8.0)).cast("bigint")))
    return span.select("clip_id", F.explode(F.array_distinct(at)).alias("frame_idx"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Frames by fragments of 12."""
    f = views.frames(spark, d).withColumn("fragment", F.floor(F.col("frame_idx") / 12))
    return f.groupBy("clip_id", "fragment").agg(F.count(F.lit(1)).alias("n"), F.max("luma").alias("luma_max"), F.min_by("ptype", "frame_idx").alias("first_type"))


QUERIES = {
    "scene_report": scene_report, "scene_cuts": scene_cuts, "scene_segments": scene_segments, "frame_scene": frame_scene, "gop_chunks": gop_chunks, "ptype_runs": ptype_runs,
    "ref_links": ref_links, "anchors_forced": anchors_forced, "drift_distance": drift_distance, "budget_anchors": budget_anchors, "ema_signal": ema_signal, "luma_diff": luma_diff,
    "sr_routing": sr_routing, "mode_router": mode_router, "cut_scores": cut_scores, "calmest_window": calmest_window, "characterised": characterised,
    "sampled_frames": sampled_frames, "fragments": fragments,
}

ORACLE_SQL = {
    "scene_report": CUTS + """
SELECT f.clip_id, g.sid, count(*) AS n, avg(f.diff) AS mean_diff, max(f.diff) AS max_diff, avg(CASE WHEN f.ptype = 'I' THEN 1.0 ELSE 0.0 END) AS i_share
FROM f JOIN segs g ON f.clip_id = g.clip_id AND f.frame_idx >= g.s0 AND f.frame_idx < g.s1 GROUP BY ALL""",
    "scene_cuts": CUTS + "SELECT clip_id, frame_idx, diff, ptype FROM f WHERE is_cut",
    "scene_segments": CUTS + "SELECT clip_id, sid, s0, s1 FROM segs",
    "frame_scene": CUTS + "SELECT f.clip_id, f.frame_idx, g.sid FROM f JOIN segs g ON f.clip_id = g.clip_id AND f.frame_idx >= g.s0 AND f.frame_idx < g.s1",
    "gop_chunks": CHUNKS,
    "ptype_runs": f"""WITH {views.FRAMES}, m AS (SELECT *, CASE WHEN ptype <> lag(ptype) OVER (PARTITION BY clip_id ORDER BY frame_idx) THEN 1 ELSE 0 END AS new FROM frames),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS INTEGER) AS run FROM m)
SELECT clip_id, run, ptype, min(frame_idx) AS lo, count(*) AS n FROM r GROUP BY ALL""",
    "ref_links": f"""WITH {views.FRAMES}, l AS (
  SELECT clip_id, frame_idx,
    max(CASE WHEN ptype IN ('I', 'P') THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ref,
    min(CASE WHEN ptype IN ('I', 'P') THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ref
  FROM frames),
w AS (SELECT *, CASE WHEN prev_ref IS NULL AND next_ref IS NULL THEN NULL WHEN next_ref IS NULL THEN 1.0 WHEN prev_ref IS NULL THEN 0.0
  ELSE CAST(next_ref - frame_idx AS DOUBLE) / (next_ref - prev_ref) END AS w_prev FROM l)
SELECT *, 1.0 - w_prev AS w_next FROM w""",
    "anchors_forced": f"""WITH {views.FRAMES}, b AS (SELECT *, CASE WHEN ptype IN ('I', 'P') THEN CAST(sum(CASE WHEN ptype IN ('I', 'P') THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS INTEGER) END AS backbone_pos FROM frames)
SELECT clip_id, frame_idx, backbone_pos, ptype = 'I' OR coalesce(backbone_pos % 4 = 0, false) AS is_anchor FROM b""",
    "drift_distance": f"""WITH {views.FRAMES}, a AS (SELECT *, ptype = 'I' OR coalesce(frame_idx = min(CASE WHEN ptype IN ('I', 'P') THEN frame_idx END) OVER (PARTITION BY clip_id), false) AS is_anchor FROM frames),
g AS (SELECT *, sum(CAST(is_anchor AS INTEGER)) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS grp FROM a),
h AS (SELECT *, CASE WHEN ptype <> 'B' THEN CAST(sum(CASE WHEN ptype <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, grp ORDER BY frame_idx) - 1 AS INTEGER) END AS hops FROM g)
SELECT clip_id, frame_idx, hops, CASE WHEN ptype = 'B' THEN frame_idx ELSE hops END AS shown_distance FROM h""",
    "budget_anchors": BUDGET,
    "ema_signal": EMA,
    "luma_diff": f"""WITH {views.FRAMES}, d AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS diff FROM frames)
SELECT clip_id, ptype, count(diff) AS n, max(diff) AS max_diff, min(diff) AS min_diff FROM d GROUP BY ALL""",
    "sr_routing": SR_ROUTING,
    "mode_router": MODE,
    "cut_scores": CUTS + """, a AS (SELECT clip_id, frame_idx FROM f WHERE is_cut), e AS (SELECT clip_id, frame_idx FROM f WHERE ptype = 'I' AND diff > 60),
j AS (SELECT coalesce(a.clip_id, e.clip_id) AS clip_id, a.clip_id IS NOT NULL AS x, e.clip_id IS NOT NULL AS y FROM a FULL JOIN e ON a.clip_id = e.clip_id AND a.frame_idx = e.frame_idx),
c AS (SELECT clip_id, count(*) FILTER (WHERE x AND y) AS tp, count(*) FILTER (WHERE x AND NOT y) AS fp, count(*) FILTER (WHERE y AND NOT x) AS fn FROM j GROUP BY clip_id)
SELECT *, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS precision, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS recall FROM c""",
    "calmest_window": f"""WITH {views.FRAMES}, d AS (SELECT *, abs(luma - lag(luma) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS diff FROM frames),
w AS (SELECT clip_id, frame_idx, max(diff) OVER x AS cost, count(*) OVER x AS have FROM d WINDOW x AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY cost, frame_idx) AS k FROM w WHERE have = 11)
SELECT clip_id, frame_idx AS start, cost FROM r WHERE k = 1""",
    "characterised": f"""WITH {views.FRAMES} SELECT clip_id, max(luma) AS luma_max, count(*) FILTER (WHERE ptype = 'I') AS n_i, string_agg(ptype, '' ORDER BY frame_idx) AS ptypes FROM frames WHERE frame_idx < 48 GROUP BY clip_id""",
    "sampled_frames": f"""WITH {views.FRAMES}, s AS (SELECT clip_id, count(*) AS n FROM frames GROUP BY clip_id)
SELECT DISTINCT clip_id, CASE WHEN n <= 8 THEN k ELSE CAST(trunc(k * (n / 8.0)) AS BIGINT) END AS frame_idx FROM (SELECT clip_id, n, unnest(range(least(n, 8))) AS k FROM s)""",
    "fragments": f"""WITH {views.FRAMES} SELECT clip_id, frame_idx // 12 AS fragment, count(*) AS n, max(luma) AS luma_max, arg_min(ptype, frame_idx) AS first_type FROM frames GROUP BY ALL""",
}
