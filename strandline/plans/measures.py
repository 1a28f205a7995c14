"""Queries over scores, packets and generated parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import refs, schedule, stats


def cell_cube(spark: SparkSession, d: str) -> DataFrame:
    return stats.cell_cube(views.scores(spark, d))


def win_rate(spark: SparkSession, d: str) -> DataFrame:
    """Model 0 against model 1 in each (win, degrade) cell: winner by both tie rules, and win counts by window."""
    cells = views.scores(spark, d).groupBy("win", "degrade").pivot("model", [0, 1]).agg(F.avg("metric"))
    cells = cells.where("`0` is not null and `1` is not null").withColumnRenamed("0", "a").withColumnRenamed("1", "b")
    cells = cells.withColumn("relative", stats.winner(F.col("a"), F.col("b"))).withColumn("absolute", stats.winner(F.col("a"), F.col("b"), 100.0, relative=False))
    return cells.groupBy("win").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("relative") == "a").alias("a_wins"), F.count_if(F.col("relative") == "tie").alias("ties"), F.count_if(F.col("absolute") == "a").alias("a_wins_absolute"),
        F.avg((F.col("a") < F.col("b")).cast("double")).alias("a_share"), F.count_if((F.col("relative") == "a") & (F.col("absolute") == "a")).alias("both"),
    )


def profile_by_type(spark: SparkSession, d: str) -> DataFrame:
    f = views.frames(spark, d)
    component = F.when(F.col("luma") % 3 < 1, "decode").when(F.col("luma") % 3 < 2, "warp").otherwise("encode")
    return stats.profile(f.select(component.alias("component"), "ptype", (F.col("clip_id") * 100000 + F.col("frame_idx")).alias("frame_idx"), F.floor("luma").cast("double").alias("ms")))


def cost_account(spark: SparkSession, d: str) -> DataFrame:
    own = refs.forced_anchors(views.frames(spark, d).withColumn("hole", F.floor("luma") / 512.0), ["clip_id"])
    return stats.cost_account(own, ["clip_id"], 180.0, 30.0)


def anchor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Operating points of every-k anchors: cost against a quality that falls with the distance, and the cheapest within 1 dB."""
    ks = (2, 4, 8)
    own = refs.anchor_grid(views.frames(spark, d).select("clip_id", "frame_idx", "ptype"), list(ks))
    psnr = [F.avg(40.0 - F.coalesce(f"hops_{k}", F.lit(2)) * 0.25).alias(f"psnr_{k}") for k in ks]
    share = [F.avg(F.col(f"is_anchor_{k}").cast("double")).alias(f"share_{k}") for k in ks]
    clips = own.groupBy("clip_id").agg(*psnr, *share)
    points = clips.select("clip_id", F.inline(F.array(*[F.struct(F.col(f"psnr_{k}").alias("psnr"), F.col(f"share_{k}").alias("anchor_share"), F.lit(k).alias("point")) for k in ks])))
    return stats.within_of_best(points, ["clip_id"], "psnr", "anchor_share", 0.25)


def rss_slope(spark: SparkSession, d: str) -> DataFrame:
    return stats.slope(views.frames(spark, d), ["clip_id"], "frame_idx", "luma")


def half_life(spark: SparkSession, d: str) -> DataFrame:
    """Half-life over frames of each clip's luma, as a curve."""
    return stats.half_life(views.frames(spark, d).select("clip_id", F.col("frame_idx").alias("dist"), (F.col("luma") - 5.0).alias("gap")), ["clip_id"])


def av_merge(spark: SparkSession, d: str) -> DataFrame:
    """Both packet streams in one order; packets after the video's end are dropped."""
    p = views.packets(spark, d)
    end = p.where("stream = 'video'").agg(F.max("t").alias("end"))
    return stats.merged(p.join(F.broadcast(end)).where("t <= end").select("stream", "rank", "t", "id"))


def audio_feed(spark: SparkSession, d: str) -> DataFrame:
    """The frame after which each audio packet is handed out, one second ahead at one frame an hour."""
    p = views.packets(spark, d).where("rank = 1")
    hour, ahead = 3_600_000_000, 1_000_000
    frame = F.greatest(F.ceil((F.col("t") - ahead) / hour) - 1, F.lit(0))
    return p.groupBy(frame.cast("bigint").alias("frame")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"))


def schedule_grid(spark: SparkSession, d: str) -> DataFrame:
    """Load, least interval, least buffer and startup time of 324 schedules."""
    g = schedule.parameter_grid(spark, (0.13, 1.0, 2.2), (24.0, 25.0, 30.0), (0.0277, 0.039, 0.042), (12, 24, 48, 96, 150, 200))
    c = [F.col(n) for n in ("latency", "fps", "cost", "every", "dedicated")]
    return g.select(
        *c, schedule.utilisation(*c).alias("load"), schedule.least_interval(c[0], c[1], c[2], c[4]).alias("min_every"), schedule.least_buffer(c[0], c[1]).alias("buffer"),
        schedule.startup(c[0], c[1], c[2], c[4]).alias("startup"),
    )


def buffer_sim(spark: SparkSession, d: str) -> DataFrame:
    """Late frames of 96 frames for 36 schedules with their least buffers; times rounded to microseconds as whole numbers."""
    g = schedule.parameter_grid(spark, (0.125, 1.0, 2.25), (16.0, 25.0), (0.03125, 0.0625, 0.0078125), (12, 48), (False,))
    g = g.withColumn("buffer", schedule.least_buffer(F.col("latency"), F.col("fps")))
    out = schedule.simulated(g, 96)
    return out.select("latency", "fps", "cost", "every", "buffer", "stalls", F.expr("cast(floor(start * 1000000 + 0.5) as bigint)").alias("start_us"), F.expr("cast(floor(last * 1000000 + 0.5) as bigint)").alias("last_us"))


def minimal_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Smallest buffer without a late frame."""
    g = schedule.parameter_grid(spark, (0.125, 1.0), (16.0, 25.0), (0.0078125, 0.03125), (24, 48), (False, True))
    return schedule.minimal_buffer(g, 60, 120).select("latency", "fps", "cost", "every", "dedicated", "min_buffer")


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Best (lo, hi) ramp over cells: the largest mean gain such that no cell gets worse by more than the limit."""
    cells = views.scores(spark, d).groupBy("win", "degrade").agg(F.avg("metric").alias("m"), F.min("metric").alias("least"))
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in (500, 1000, 2000, 4000)])).alias("lo")).select("lo", F.explode(F.array(*[F.lit(float(x)) for x in (1000, 2000, 4000, 8000)])).alias("hi")).where("lo < hi")
    both = cells.crossJoin(F.broadcast(grid))  # ten parameter pairs
    beta = F.least(F.greatest((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    tried = both.withColumn("gain", beta * (F.col("m") - F.col("least")) / 1000 - beta * beta)
    ok = tried.groupBy("lo", "hi").agg(F.avg("gain").alias("gain"), F.min("gain").alias("worst")).where("worst >= -0.9")
    return ok.agg(F.max_by(F.struct("lo", "hi", "gain"), F.struct(F.col("gain"), -F.col("lo"), -F.col("hi"))).alias("b")).where("b is not null").select("b.*")


def beta_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each window's curve (share of documents by length step) read at three places by linear interpolation."""
    s = views.scores(spark, d)
    points = s.groupBy("win", (F.floor(F.col("metric") / 1000).cast("int")).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    xs = s.select("win").distinct().select("win", F.explode(F.array(F.lit(-1.0), F.lit(0.5), F.lit(2.25))).alias("at"))
    return stats.lookup(points, xs, ["win"])


def mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = views.scores(spark, d)
    return s.groupBy("win").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.median("metric").alias("middle"), F.percentile("metric", F.array(F.lit(0.1), F.lit(0.9))).alias("p")).select("win", "n", "mean", "middle", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90"))


QUERIES = {
    "cell_cube": cell_cube, "win_rate": win_rate, "profile_by_type": profile_by_type, "cost_account": cost_account, "anchor_sweep": anchor_sweep, "rss_slope": rss_slope, "half_life": half_life,
    "av_merge": av_merge, "audio_feed": audio_feed, "schedule_grid": schedule_grid, "buffer_sim": buffer_sim, "minimal_buffers": minimal_buffers, "grid_search": grid_search,
    "beta_lookup": beta_lookup, "mean_metrics": mean_metrics,
}

ORACLE_SQL = {
    "cell_cube": f"""WITH {views.SCORES} SELECT win, degrade, model, grouping(win, degrade, model) AS level, count(*) AS n, sum(metric) AS total, avg(metric) AS mean
FROM scores GROUP BY CUBE (win, degrade, model) HAVING grouping(win, degrade, model) % 2 = 0""",
    "win_rate": f"""WITH {views.SCORES}, c AS (SELECT win, degrade, avg(metric) FILTER (WHERE model = 0) AS a, avg(metric) FILTER (WHERE model = 1) AS b FROM scores GROUP BY ALL),
w AS (SELECT *, CASE WHEN abs(a - b) / greatest(abs(a), abs(b), 1e-9) < 0.03 THEN 'tie' WHEN a < b THEN 'a' ELSE 'b' END AS r, CASE WHEN abs(a - b) < 100 THEN 'tie' WHEN a < b THEN 'a' ELSE 'b' END AS s FROM c WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT win, count(*) AS cells, count(*) FILTER (WHERE r = 'a') AS a_wins, count(*) FILTER (WHERE r = 'tie') AS ties, count(*) FILTER (WHERE s = 'a') AS a_wins_absolute, avg(CASE WHEN a < b THEN 1.0 ELSE 0.0 END) AS a_share,
  count(*) FILTER (WHERE r = 'a' AND s = 'a') AS both FROM w GROUP BY win""",
    "profile_by_type": f"""WITH {views.FRAMES}, e AS (SELECT CASE WHEN luma % 3 < 1 THEN 'decode' WHEN luma % 3 < 2 THEN 'warp' ELSE 'encode' END AS component, ptype, floor(luma) AS ms FROM frames),
s AS (SELECT component, ptype, sum(ms) AS ms FROM e GROUP BY ALL), n AS (SELECT ptype, count(*) AS frames FROM frames GROUP BY ptype),
t AS (SELECT c.component, n.ptype, n.frames, coalesce(s.ms, 0) AS ms FROM (SELECT DISTINCT component FROM s) c CROSS JOIN n LEFT JOIN s ON s.component = c.component AND s.ptype = n.ptype)
SELECT component, ptype, sum(ms) / sum(frames) AS mean_ms, CAST(sum(frames) AS BIGINT) AS frames FROM t GROUP BY GROUPING SETS ((component, ptype), (component))""",
    "cost_account": f"""WITH {views.FRAMES}, a AS (SELECT *, floor(luma) / 512.0 AS hole, ptype = 'I' OR coalesce(frame_idx = min(CASE WHEN ptype IN ('I', 'P') THEN frame_idx END) OVER (PARTITION BY clip_id), false) AS is_anchor FROM frames),
s AS (SELECT clip_id, count(*) AS n, CAST(sum(is_anchor::INT) AS BIGINT) AS anchors, coalesce(sum(hole) FILTER (WHERE NOT is_anchor), 0) AS holes FROM a GROUP BY clip_id),
t AS (SELECT *, anchors + holes AS equivalents, (anchors + holes) / n AS share FROM s)
SELECT *, share * 180.0 + 30.0 AS ms, 1000.0 / (share * 180.0 + 30.0) AS fps FROM t""",
    "anchor_sweep": f"""WITH {views.FRAMES}, k AS (SELECT unnest([2, 4, 8]) AS point),
b AS (SELECT *, CASE WHEN ptype <> 'B' THEN sum(CASE WHEN ptype <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 END AS bp FROM frames),
a AS (SELECT b.*, k.point, ptype = 'I' OR coalesce(bp % k.point = 0, false) AS an FROM b CROSS JOIN k),
g AS (SELECT *, sum(an::INT) OVER (PARTITION BY clip_id, point ORDER BY frame_idx) AS grp FROM a),
h AS (SELECT *, CASE WHEN ptype <> 'B' THEN sum(CASE WHEN ptype <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, point, grp ORDER BY frame_idx) - 1 END AS hops FROM g),
p AS (SELECT clip_id, point, avg((40.0 - coalesce(hops, 2) * 0.25)::DOUBLE) AS psnr, avg(an::INT::DOUBLE) AS anchor_share FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY anchor_share, point) AS k FROM (SELECT *, max(psnr) OVER (PARTITION BY clip_id) AS best FROM p) WHERE psnr >= best - 0.25)
SELECT clip_id, CAST(point AS INTEGER) AS point, psnr, anchor_share FROM r WHERE k = 1""",
    "rss_slope": f"""WITH {views.FRAMES}, m AS (SELECT *, max(frame_idx) OVER (PARTITION BY clip_id) AS most FROM frames)
SELECT clip_id, regr_slope(luma, frame_idx) AS slope, count(*) AS n FROM m WHERE frame_idx >= 0.3::DOUBLE * most GROUP BY clip_id""",
    "half_life": f"""WITH {views.FRAMES}, p AS (SELECT clip_id, frame_idx AS x, luma - 5.0 AS y, first_value(luma - 5.0) OVER w AS g0, lag(frame_idx) OVER w AS px, lag(luma - 5.0) OVER w AS py FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
h AS (SELECT *, CASE WHEN px IS NULL OR py = y THEN x ELSE px + (py - g0 / 2) / (py - y) * (x - px) END AS hit FROM p)
SELECT clip_id, CASE WHEN first(g0) <= 0 THEN NULL ELSE coalesce(arg_min(hit, x) FILTER (WHERE y <= g0 / 2), max(x))::DOUBLE END AS half_life FROM h GROUP BY clip_id""",
    "av_merge": f"WITH {views.PACKETS} SELECT stream, rank, t, id FROM packets WHERE t <= (SELECT max(t) FROM packets WHERE stream = 'video') ORDER BY t, rank, id",
    "audio_feed": f"""WITH {views.PACKETS} SELECT CAST(greatest(ceil((t - 1000000) / 3600000000.0::DOUBLE) - 1, 0) AS BIGINT) AS frame, count(*) AS n, min(t) AS first_t FROM packets WHERE rank = 1 GROUP BY 1""",
    "schedule_grid": """WITH g AS (SELECT latency::DOUBLE AS latency, fps::DOUBLE AS fps, cost::DOUBLE AS cost, every, dedicated
  FROM (SELECT unnest([0.13, 1.0, 2.2]) AS latency), (SELECT unnest([24.0, 25.0, 30.0]) AS fps), (SELECT unnest([0.0277, 0.039, 0.042]) AS cost), (SELECT unnest([12, 24, 48, 96, 150, 200]) AS every), (SELECT unnest([false, true]) AS dedicated))
SELECT *, CASE WHEN dedicated THEN greatest(fps * cost, fps / every * latency) ELSE fps * cost + fps / every * latency END AS load,
  CASE WHEN dedicated THEN latency * fps WHEN 1.0 / fps - cost <= 0 THEN 'inf'::DOUBLE ELSE latency / (1.0 / fps - cost) END AS min_every,
  CAST(ceil(latency * fps - 1e-9) AS INTEGER) AS buffer,
  CASE WHEN dedicated THEN greatest(latency, ceil(latency * fps - 1e-9) * cost) ELSE latency + ceil(latency * fps - 1e-9) * cost END AS startup FROM g""",
    "buffer_sim": """WITH RECURSIVE g AS (SELECT row_number() OVER () AS id, latency::DOUBLE AS latency, fps::DOUBLE AS fps, cost::DOUBLE AS cost, every, CAST(ceil(latency * fps - 1e-9) AS INTEGER) AS buffer
  FROM (SELECT unnest([0.125, 1.0, 2.25]::DOUBLE[]) AS latency), (SELECT unnest([16.0, 25.0]::DOUBLE[]) AS fps), (SELECT unnest([0.03125, 0.0625, 0.0078125]::DOUBLE[]) AS cost), (SELECT unnest([12, 48]) AS every)),
r AS (
  SELECT id, 0 AS i, latency + cost AS made, CASE WHEN buffer = 1 THEN latency + cost END AS start, CASE WHEN buffer = 1 THEN [latency + cost] ELSE []::DOUBLE[] END AS shown, 0 AS stalls, latency, fps, cost, every, buffer FROM g
  UNION ALL
  SELECT id, i + 1, made2, CASE WHEN i + 1 = buffer - 1 THEN made2 ELSE start END,
    CASE WHEN i + 1 < buffer - 1 THEN shown WHEN i + 1 = buffer - 1 THEN list_transform(range(buffer), lambda k: made2 + k * (1.0::DOUBLE / fps)) ELSE list_append(shown, greatest_time) END,
    stalls + CASE WHEN i + 1 >= buffer AND made2 > shown[len(shown)] + 1.0::DOUBLE / fps + 1e-9 THEN 1 ELSE 0 END, latency, fps, cost, every, buffer
  FROM (SELECT *, CASE WHEN made2 > shown[len(shown)] + 1.0::DOUBLE / fps + 1e-9 THEN made2 ELSE shown[len(shown)] + 1.0::DOUBLE / fps END AS greatest_time
        FROM (SELECT *, (CASE WHEN i + 1 < buffer THEN made ELSE greatest(made, shown[i + 2 - buffer]) END) + (CASE WHEN (i + 1) % every = 0 THEN cost + latency ELSE cost END) AS made2 FROM r WHERE i < 95)))
SELECT latency, fps, cost, every, buffer, stalls, CAST(floor(start * 1000000 + 0.5) AS BIGINT) AS start_us, CAST(floor(shown[len(shown)] * 1000000 + 0.5) AS BIGINT) AS last_us FROM r WHERE i = 95""",
    "minimal_buffers": """WITH RECURSIVE g AS (SELECT latency, fps, cost, every, dedicated, CASE WHEN dedicated THEN greatest(fps * cost, fps / every * latency) ELSE fps * cost + fps / every * latency END <= 1 + 1e-9 AS ok
  FROM (SELECT unnest([0.125, 1.0]::DOUBLE[]) AS latency), (SELECT unnest([16.0, 25.0]::DOUBLE[]) AS fps), (SELECT unnest([0.0078125, 0.03125]::DOUBLE[]) AS cost), (SELECT unnest([24, 48]) AS every), (SELECT unnest([false, true]) AS dedicated)),
b AS (SELECT row_number() OVER () AS id, g.*, least(buffer, 120) AS buffer FROM g, (SELECT unnest(range(1, 61)) AS buffer) WHERE ok),
r AS (
  SELECT id, 0 AS i, latency + cost AS made, CASE WHEN buffer = 1 THEN [latency + cost] ELSE []::DOUBLE[] END AS shown, 0 AS late, latency, fps, cost, every, dedicated, buffer FROM b
  UNION ALL
  SELECT id, i + 1, made2, CASE WHEN i + 1 < buffer - 1 THEN shown WHEN i + 1 = buffer - 1 THEN list_transform(range(buffer), lambda k: made2 + k * (1.0::DOUBLE / fps)) ELSE list_append(shown, CASE WHEN slow THEN made2 ELSE due END) END,
    late + CASE WHEN i + 1 >= buffer AND slow THEN 1 ELSE 0 END, latency, fps, cost, every, dedicated, buffer
  FROM (SELECT *, made2 > due + 1e-9 AS slow FROM (SELECT *, shown[len(shown)] + 1.0::DOUBLE / fps AS due,
      CASE WHEN (i + 1) % every = 0 AND dedicated THEN greatest(ready, ((i + 1) // every + 1) * latency) ELSE ready END + cost + CASE WHEN (i + 1) % every = 0 AND NOT dedicated THEN latency ELSE 0 END AS made2
    FROM (SELECT *, CASE WHEN i + 1 < buffer THEN made ELSE greatest(made, shown[i + 2 - buffer]) END AS ready FROM r WHERE i < 119)))),
m AS (SELECT latency, fps, cost, every, dedicated, min(buffer) AS min_buffer FROM r WHERE i = 119 AND late = 0 GROUP BY ALL)
SELECT g.latency, g.fps, g.cost, g.every, g.dedicated, CAST(m.min_buffer AS INTEGER) AS min_buffer FROM g LEFT JOIN m USING (latency, fps, cost, every, dedicated)""",
    "grid_search": f"""WITH {views.SCORES}, c AS (SELECT win, degrade, avg(metric) AS m, min(metric) AS least FROM scores GROUP BY ALL),
g AS (SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT unnest([500, 1000, 2000, 4000]) AS lo), (SELECT unnest([1000, 2000, 4000, 8000]) AS hi) WHERE lo < hi),
b AS (SELECT *, least(greatest((m - lo) / (hi - lo), 0), 1) AS beta FROM c, g), t AS (SELECT lo, hi, beta * (m - least) / 1000 - beta * beta AS gain FROM b),
s AS (SELECT lo, hi, avg(gain) AS gain, min(gain) AS worst FROM t GROUP BY lo, hi)
SELECT lo, hi, gain FROM s WHERE worst >= -0.9 ORDER BY gain DESC, lo, hi LIMIT 1""",
    "beta_lookup": f"""WITH {views.SCORES}, p AS (SELECT win, CAST(floor(metric / 1000) AS INTEGER) AS x, count(*)::DOUBLE AS y FROM scores GROUP BY ALL),
q AS (SELECT win, unnest([-1.0, 0.5, 2.25]::DOUBLE[]) AS at FROM (SELECT DISTINCT win FROM scores)),
b AS (SELECT q.win, q.at, max(p.x) FILTER (WHERE p.x <= q.at) AS lo, min(p.x) FILTER (WHERE p.x >= q.at) AS hi FROM q JOIN p USING (win) GROUP BY ALL)
SELECT b.win, b.at, CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR lo = hi THEN l.y ELSE l.y + (b.at - lo) / (hi - lo) * (h.y - l.y) END AS value
FROM b LEFT JOIN p l ON l.win = b.win AND l.x = b.lo LEFT JOIN p h ON h.win = b.win AND h.x = b.hi""",
    "mean_metrics": f"WITH {views.SCORES} SELECT win, count(*) AS n, avg(metric) AS mean, median(metric) AS middle, quantile_cont(metric, 0.1) AS p10, quantile_cont(metric, 0.9) AS p90 FROM scores GROUP BY win",
}
