"""Queries of gates, rules and small column functions over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import arrow, columns, kernels
from ..operators import motion, refs, routing, segment, stats, tiles
from ..sources import readers, sinks
from .motion import RASTER
from .pixels import GATE, P3, VECTORS, frame_vectors, plate_median, tile_blockiness, tile_psnr
from .recon import planes
from .streams import CUTS


def probed(spark: SparkSession, d: str) -> DataFrame:
    """Rate and number of frames of containers whose numbers are only partly known."""
    o, k = views.table(spark, d, "orders"), F.col("o_orderkey")
    rate = lambda num, den: F.struct(F.lit(num).alias("num"), F.lit(den).alias("den"))
    fps = columns.frame_rate(F.when(k % 4 == 0, rate(24000, 1001)), F.when(k % 4 == 1, rate(30, 1)), F.when(k % 4 == 2, rate(50, 2)))
    own = o.select("o_orderkey", F.when(k % 3 == 0, F.col("o_custkey")).alias("stated"), (F.col("o_custkey") / 8.0).alias("duration"), fps.alias("fps"))
    n = columns.frame_count(F.col("stated"), F.when(k % 5 != 0, F.col("duration")), F.col("fps.num") / F.col("fps.den"), F.lit(900))
    return own.select("o_orderkey", F.col("fps.num").alias("num"), F.col("fps.den").alias("den"), n.alias("n_frames"))


def clip_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files by name, of which several folders hold some; times by mode."""
    files = views.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("folder_rank"), (F.col("p_size") * 25).alias("n_frames"), F.lit(25.0).alias("fps"))
    modes = spark.createDataFrame([("instant", 130.0), ("layered", 1400.0), ("quality", 2900.0)], "mode string, ms_frame double")
    return readers.source_catalog(files, modes)


def picture_types(spark: SparkSession, d: str) -> DataFrame:
    """Records, frames and distinct places by picture type."""
    li = views.table(spark, d, "lineitem").select(columns.picture_type(F.col("l_linenumber") % 5).alias("ptype"), "l_orderkey", "l_suppkey")
    return li.groupBy("ptype").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("frames"), F.count_distinct("l_suppkey", "l_orderkey").alias("places"))


def packed_records(spark: SparkSession, d: str) -> DataFrame:
    """Motion records packed ten numbers each into one array a frame, and unpacked again."""
    m = views.mvs(spark, d)
    ten = F.array(*[F.col(c).cast("int") for c in ("source", "w", "h")], *[F.col(c).cast("int") for c in ("dst_x", "dst_y") * 2], F.col("motion_x"), F.col("motion_y"), F.col("motion_scale"))
    packed = m.groupBy("frame_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("mv_idx", ten.alias("v")))), lambda r: r["v"])).alias("packed"))
    return motion.unpacked(packed).select("frame_id", "mv_idx", "source", "w", "dst_x", "dst_y", "motion_x", "motion_y")


def frames_with_motion(spark: SparkSession, d: str) -> DataFrame:
    """The pull interface: frames of a window with their records in order; frames without records stay."""
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderkey").alias("frame_idx"))
    own = readers.with_motion(readers.frame_window(o, 100, 4000), views.mvs(spark, d).where("w = 16"), ["frame_id"])
    return own.select("frame_id", F.coalesce(F.size("mvs"), F.lit(0)).alias("n"), F.get("mvs", F.lit(0))["motion_x"].alias("first_x"), F.element_at("mvs", -1)["motion_x"].alias("last_x"))


def json_results(spark: SparkSession, d: str) -> DataFrame:
    """Scores written as JSON lines of a log and parsed again; broken lines give nulls and are left out."""
    s = views.scores(spark, d)
    line = F.when(F.col("doc_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("win", "model", "metric")))
    parsed = s.select(F.from_json(line, "win string, model int, metric double").alias("r")).select("r.*").where("metric is not null")
    return parsed.groupBy("win", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"))


def rounding_report(spark: SparkSession, d: str) -> DataFrame:
    """Quarters rounded half to even, half up, cut off, down and up."""
    v = F.col("l_linenumber") * F.col("l_suppkey") / 4.0 - 6
    own = views.table(spark, d, "lineitem").select(v.alias("v")).distinct()
    return own.select("v", F.bround("v").alias("even"), F.floor(F.col("v") + 0.5).cast("bigint").alias("half_up"), F.col("v").cast("bigint").alias("cut"), F.floor("v").cast("bigint").alias("down"), F.ceil("v").cast("bigint").alias("up"))


def plate_guard(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose background PSNR is under a floor or far under the moving average of its scene's frames that passed; a PSNR that is not finite is trusted."""
    return routing.guarded(tile_psnr(spark, d), ["scene"], "frame_idx", "psnr", 4.0, 0.5).select("scene", "frame_idx", "bad")


def deblock_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each tile is deblocked, by three modes and with a texture guard."""
    b = tile_blockiness(spark, d).join(tiles.var_laplacian(views.tiles(spark, d)), ["scene", "frame_idx"])
    qp = F.when(F.col("frame_idx") % 7 != 0, (F.col("frame_idx") % 52).cast("int"))
    texture = F.col("sharpness") / 50000.0
    gate = lambda mode, *guard: routing.deblock_gate(mode, qp, F.col("blockiness"), *guard, limit=1.05)
    return b.select("scene", "frame_idx", gate("always").alias("always"), gate("qp").alias("by_qp"), gate("blockiness").alias("by_step"), gate("qp", texture).alias("guarded"))


def best_modes(spark: SparkSession, d: str) -> DataFrame:
    """The mode of each clip that its measurements confirm; clips lack some modes."""
    f = views.frames(spark, d)
    mode = F.when(F.col("ptype") == "I", "layered").when(F.col("ptype") == "P", "quality").otherwise("instant")
    own = f.withColumn("mode", mode).groupBy(F.col("clip_id").alias("clip"), "mode").agg(
        F.max("luma").alias("tof"), F.min("luma").alias("consistency"), (F.min("luma") * 2).alias("ms"), F.lit(True).alias("safe")
    )
    own = own.withColumn("safe", F.col("clip") % 3 != 0)
    return routing.best_by_outcome(own).select("clip", "best")


def layered_costs(spark: SparkSession, d: str) -> DataFrame:
    """ms a frame of the layered mode by scene and matte refresh."""
    s = views.tiles(spark, d).groupBy("scene").agg(F.count_distinct("frame_idx").alias("n"))
    own = s.withColumn("refresh", F.explode(F.array(F.lit(1), F.lit(2), F.lit(6))))
    return own.select("scene", "refresh", "n", columns.layered_cost(F.col("n"), 4.0, 300.0, F.col("refresh"), 42.0, 6.5, 3.25, 900.0).alias("ms"))


def beta_select(spark: SparkSession, d: str) -> DataFrame:
    """Blend factor of each tile from its sharpness and blockiness, and a gate by its frame's motion."""
    own = tile_blockiness(spark, d).join(tiles.var_laplacian(views.tiles(spark, d)), ["scene", "frame_idx"])
    beta = columns.adaptive_beta(F.col("sharpness"), F.col("blockiness"), (5000.0, 60000.0), (0.8, 1.3))
    return own.select("scene", "frame_idx", beta.alias("beta"), columns.motion_gate((F.col("frame_idx") % 9).cast("double"), 1.5, 6.0).alias("gate"))


def occluded_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Records whose vector is not undone by the one that follows in their frame, by frame."""
    order = Window.partitionBy("frame_id").orderBy("mv_idx")
    p = motion.projected(views.mvs(spark, d)).withColumn("bx", F.lead("dx").over(order)).withColumn("by", F.lead("dy").over(order)).where("bx is not null")
    return p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(columns.occluded(F.col("dx"), F.col("dy"), F.col("bx"), F.col("by"))).alias("occluded"))


def colour_clamp(spark: SparkSession, d: str) -> DataFrame:
    """What a place showed a frame before, held within one and a half deviations of the 3 x 3 box around the place now."""
    row = Window.partitionBy("scene", "frame_idx", F.floor(F.col("pos") / 8)).orderBy("pos").rowsBetween(-1, 1)
    column = Window.partitionBy("scene", "frame_idx", F.col("pos") % 8).orderBy("pos").rowsBetween(-1, 1)
    history = F.lag("luma").over(Window.partitionBy("scene", "pos").orderBy("frame_idx"))
    t = views.tiles(spark, d).withColumn("history", history).withColumn("q", F.col("luma") * F.col("luma")).withColumn("one", F.lit(1))
    for w in (row, column):  # a box is a column of rows
        t = t.withColumns({f"s_{c}": F.sum(c if w is row else f"s_{c}").over(w) for c in ("luma", "q", "one")})
    mean = F.col("s_luma") / F.col("s_one")
    std = F.sqrt(F.greatest(F.col("s_q") / F.col("s_one") - mean * mean, F.lit(0.0)))
    own = t.where("history is not null").withColumn("held", columns.clamped(F.col("history"), mean, std, 1.5))
    return own.groupBy("scene", "frame_idx").agg(F.count_if(F.abs(F.col("held") - F.col("history")) > 1).alias("moved"), F.min("held").alias("low"), F.max("held").alias("high"))


def rgb_luma(spark: SparkSession, d: str) -> DataFrame:
    """Luma of pixels whose three channels are neighbouring samples of a tile."""
    row = Window.partitionBy("scene", "frame_idx").orderBy("pos")
    t = views.tiles(spark, d).withColumn("g", F.lead("luma", 1).over(row)).withColumn("b", F.lead("luma", 2).over(row)).where("pos % 3 = 0 and b is not null")
    return t.groupBy("scene", "frame_idx").agg(F.avg(columns.luma(F.col("luma"), F.col("g"), F.col("b"))).alias("y"))


def masked_sharpness(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness inside a mask of each frame, and its mean over the scene."""
    own = tiles.var_laplacian(views.tiles(spark, d), mask=(F.col("frame_idx") + F.col("pos")) % 2 == 0)
    return own.groupBy("scene").agg(F.avg("sharpness").alias("mean"), F.max("sharpness").alias("most"), F.count("sharpness").alias("n"))


def band_change(spark: SparkSession, d: str) -> DataFrame:
    """Temporal change of tiles inside bands by distance from the middle."""
    x, y = F.col("pos") % 8, F.floor(F.col("pos") / 8)
    far = F.greatest(F.abs(2 * x - 7), F.abs(2 * y - 7))
    band = F.when(far <= 2, "core").when(far <= 4, "ring").otherwise("rim")
    change = F.abs(F.col("luma") - F.lag("luma").over(Window.partitionBy("scene", "pos").orderBy("frame_idx")))
    own = views.tiles(spark, d).withColumn("band", band).withColumn("change", change)
    return own.groupBy("scene", "band").agg(F.avg("change").alias("change"), F.count("change").alias("n"))


def background_psnr(spark: SparkSession, d: str) -> DataFrame:
    """PSNR over the open background against the plate: 99 where they agree, infinite where too little is open."""
    both = views.tiles(spark, d).join(plate_median(spark, d).select("scene", "pos", "value"), ["scene", "pos"])
    open_ = F.expr(f"not ({GATE})") & (F.col("pos") % 5 != 0)
    out = both.groupBy("scene", "frame_idx").agg(F.avg(F.when(open_, (F.col("luma") - F.col("value")) * (F.col("luma") - F.col("value")))).alias("mse"), F.count_if(open_).alias("n"))
    value = F.when(F.col("n") < 17, float("inf")).otherwise(tiles.psnr_of(F.col("mse"), 1e-6, 99.0))
    return out.select("scene", "frame_idx", "n", value.alias("psnr"))


def leaf_patches(spark: SparkSession, d: str) -> DataFrame:
    """Frames with many holes take the heavy result exactly inside their holes; skipped frames and others keep the cheap one."""
    both = views.tiles(spark, d).join(plate_median(spark, d).select("scene", "pos", F.col("plate").cast("double").alias("cheap")), ["scene", "pos"])
    rows = both.withColumn("hole", F.col("luma") > 160).withColumn("heavy", F.floor("luma").cast("double"))
    skip = rows.where("frame_idx % 5 = 0").select("scene", "frame_idx")
    out = tiles.patched(rows, skip, 0.15)
    return out.groupBy("scene", "frame_idx").agg(F.count_if("patched").alias("patched"), F.sum("value").alias("total"))


def registered_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of each tile against the one before, moved by two columns; columns that enter are left out."""
    return tiles.registered_change(views.tiles(spark, d), F.lit(2))


def best_crops(spark: SparkSession, d: str) -> DataFrame:
    """The sharpest 4x4 crop of each tile on a grid of two; the first one on ties."""
    return tiles.best_crop(views.tiles(spark, d), 4, 2)


def plate_samples(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's view of its scene's plate under a camera that moves by whole samples."""
    plate = plate_median(spark, d).select("scene", "pos", F.col("value"))
    shift = views.tiles(spark, d).select("scene", "frame_idx").distinct().withColumn("dx", (F.col("frame_idx") % 3 - 1).cast("int")).withColumn("dy", (F.col("frame_idx") % 2).cast("int"))
    out = tiles.sampled_plate(plate, shift)
    return out.groupBy("scene", "frame_idx").agg(F.sum("value").alias("total"), F.max_by("value", "pos").alias("corner"))


def blend_family(spark: SparkSession, d: str) -> DataFrame:
    """Blends of each tile with its plate: linear with a gain over 1, and high frequencies where their signs agree."""
    plate = plate_median(spark, d).select("scene", "pos", F.col("plate").cast("double").alias("b"))
    both = views.tiles(spark, d).withColumn("a", F.floor("luma").cast("double")).join(plate, ["scene", "pos"])
    row = Window.partitionBy("scene", "frame_idx", F.floor(F.col("pos") / 8)).orderBy("pos").rowsBetween(-1, 1)
    both = both.withColumn("ha", F.col("a") - F.avg("a").over(row)).withColumn("hb", F.col("b") - F.avg("b").over(row))
    linear = tiles.blended(F.col("a"), F.col("b"), 1.25)
    return both.groupBy("scene", "frame_idx").agg(F.sum(linear).alias("linear"), F.sum(tiles.agreeing(F.col("a"), F.col("ha"), F.col("hb"), 0.75)).alias("agreeing"))


def beta_maps(spark: SparkSession, d: str) -> DataFrame:
    """Blend factors of each place from the scene's mean texture, degradation and disagreement."""
    row = Window.partitionBy("scene", "frame_idx", F.floor(F.col("pos") / 8)).orderBy("pos").rowsBetween(-1, 1)
    t = views.tiles(spark, d).join(plate_median(spark, d).select("scene", "pos", "value"), ["scene", "pos"])
    t = t.withColumn("dev", F.stddev_pop("luma").over(row)).withColumn("gap", F.abs(F.col("luma") - F.col("value"))).withColumn("dev2", F.stddev_pop("gap").over(row))
    maps = t.groupBy("scene", "pos").agg(F.avg("dev").alias("texture"), F.avg("dev2").alias("disagreement"), F.avg("gap").alias("detail"))
    beta = columns.beta_maps(F.col("texture"), F.col("detail"), F.col("disagreement"), (8.0, 22.0), (10.0, 30.0), (4.0, 14.0), 0.3)
    return maps.select("scene", "pos", *[b.alias(n) for n, b in beta.items()])


def layered_frames(spark: SparkSession, d: str) -> DataFrame:
    """Three passes: plates by scene, their guard by frame, then the subject laid over the plate or, where the plate is bad, the frame itself."""
    t, plate = views.tiles(spark, d), plate_median(spark, d)
    guard = plate_guard(spark, d)
    out = tiles.layered(t.withColumn("alpha", F.expr("(pos % 5) / 4.0D")), plate.select("scene", "pos", "plate"), guard)
    return out.groupBy("scene", "frame_idx").agg(F.max("layered").alias("layered"), F.sum("value").cast("bigint").alias("total"))


def soft_patches(spark: SparkSession, d: str) -> DataFrame:
    """High frequencies smoothed over a scene and added inside feathered, distrusted places; anchors reset and seed the smoothing."""
    both = views.tiles(spark, d).join(plate_median(spark, d).select("scene", "pos", F.col("plate").cast("double").alias("cheap")), ["scene", "pos"])
    line = Window.partitionBy("scene", "pos").orderBy("frame_idx")
    near = Window.partitionBy("scene", "frame_idx", F.floor(F.col("pos") / 8)).orderBy("pos").rowsBetween(-1, 1)
    rows = both.withColumn("k", (F.row_number().over(line) - 1).cast("int")).withColumn("before", F.lag("luma").over(line))
    rows = rows.withColumn("anchor", F.col("k") % 12 == 0).withColumn("run", F.col("anchor") | (F.col("k") % 4 != 3))
    rows = rows.withColumn("feather", F.avg((F.col("luma") > 160).cast("int")).over(near))
    rows = rows.withColumn("trust", columns.ramp(F.abs(F.col("luma") - F.col("before")), 10.0, 60.0))
    out = tiles.soft_patched(rows.withColumn("heavy", F.floor("luma").cast("double")).withColumn("value", F.col("cheap") + 4), tiles.SOFT_POLICIES["smoothed"])
    return out.groupBy("scene", "frame_idx").agg(F.count_if("patched").alias("patched"), F.sum("soft").alias("total"))


def chroma_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Cuts by four rules, the last one by a chroma plane; fired_by is the first rule that held."""
    f = views.frames(spark, d).withColumn("chroma", F.abs(F.col("luma") - 250) / 2 + F.when(F.col("frame_idx") % 29 == 28, 150.0).otherwise(0.0)).withColumn("luma", F.col("luma") / 8)
    return segment.scene_cuts(f, chroma="chroma").where("fired_by is not null").select("clip_id", "frame_idx", "diff", "is_cut", "fired_by")


def combined_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Variants of the cut rules over one difference, luma plus a weight times chroma: cuts of each clip by weight."""
    f = views.frames(spark, d)
    line = Window.partitionBy("clip_id").orderBy("frame_idx")
    step = lambda c: F.coalesce(F.abs(c - F.lag(c).over(line)), F.lit(0.0))
    # the running sum of the differences has just these differences
    rows = f.withColumn("dl", step(F.col("luma") / 8)).withColumn("dc", step(F.col("luma") % 64))
    weights = rows.withColumn("w", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    own = weights.withColumn("clip", F.col("clip_id")).withColumn("clip_id", F.col("clip_id") * 3 + F.col("w"))
    own = own.withColumn("luma", F.sum(F.floor(F.col("dl") + F.col("w") * F.col("dc"))).over(line).cast("double")).drop("dl", "dc")
    cuts = segment.scene_cuts(own)
    return cuts.groupBy("clip", "w").agg(F.count_if("is_cut").alias("cuts"), F.max("diff").alias("most"))


def legacy_chain(spark: SparkSession, d: str) -> DataFrame:
    """References in display order against those on the backbone: how many frames' references differ, and the hops of both chains."""
    return refs.chain_comparison(views.frames(spark, d))


def bench_table(spark: SparkSession, d: str) -> DataFrame:
    """Two variants over the same chunks: times by percentile and the quality delta."""
    f = views.frames(spark, d).withColumn("chunk", F.floor(F.col("frame_idx") / 8))
    ms = lambda v, c: f.groupBy("clip_id", "chunk").agg(F.sum(c).alias("ms"), F.max("luma").alias("quality")).withColumn("variant", F.lit(v))
    rows = ms("before", F.col("luma")).unionByName(ms("after", F.col("luma") / 4).withColumn("quality", F.col("quality") - 1))
    return stats.before_after(rows, ["clip_id", "chunk"])


def doubled_frames(spark: SparkSession, d: str) -> DataFrame:
    """Left neighbours across chunk borders and the copy at each clip's end."""
    own = sinks.with_trailing_copy(views.frames(spark, d))
    return own.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.sum("left").alias("left_sum"), F.max("frame_idx").alias("last"), F.max_by("luma", "frame_idx").alias("last_luma"))


def muxed(spark: SparkSession, d: str) -> DataFrame:
    """Picture and sound packets in one order with their places; sound ends with the picture."""
    p = views.packets(spark, d).withColumn("t", F.col("t") / 1e6)
    video, audio = p.where("rank = 0").select("t", "id"), p.where("rank = 1").select("t", "id")
    out = sinks.mux_order(video, audio, 86400 * 90, 25.0)
    return out.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.min("t").alias("first"))


def output_check(spark: SparkSession, d: str) -> DataFrame:
    """Counts, sizes and sound of each clip's output against what was asked for."""
    f = views.frames(spark, d).select(F.col("clip_id").alias("clip"), "frame_idx", F.when(F.col("clip_id") % 11 == 0, F.col("frame_idx") % 2).otherwise(F.lit(0)).alias("w"), F.lit(8).alias("h"), F.lit(25.0).alias("fps"))
    sound = f.where("clip % 4 <> 0").groupBy("clip").agg((F.count(F.lit(1)) / 25.0 + F.when(F.col("clip") % 3 == 0, 0.75).otherwise(0.25)).alias("t"))
    want = f.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("clip") % 7 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return sinks.verified(f, sound, want)


def hole_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of cells without a vector and of distrusted ones by clip of frames."""
    f = motion.motion_signal(motion.direction(views.mvs(spark, d), "past"), views.GRID_W, views.GRID_H)
    return f.groupBy((F.col("frame_id") % 20).cast("int").alias("clip")).agg(F.avg("intra").alias("hole_frac"), F.count_if(F.col("intra") > 0.9).alias("over"), F.count(F.lit(1)).alias("n"))


def chunk_state(spark: SparkSession, d: str) -> DataFrame:
    """A smoothed signal that starts anew at each scene of a clip, and the value that each chunk takes over from the one before."""
    cut = segment.scene_cuts(views.frames(spark, d))
    own = refs.ema(cut.withColumn("again", F.col("is_cut") | (F.col("ptype") == "I")), "luma", 0.25, "again")
    line = Window.partitionBy("clip_id").orderBy("frame_idx")
    own = own.withColumn("carried", F.lag("ema").over(line)).where("frame_idx % 16 = 0")
    return own.select("clip_id", "frame_idx", "carried", "ema")


def interp_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring tiles between which a middle frame may be made: no step like a cut between them, and few cells of the later one without a vector."""
    line = Window.partitionBy("scene").orderBy("frame_idx")
    f = views.tiles(spark, d).groupBy("scene", "frame_idx").agg(F.avg("luma").alias("luma"))
    f = f.withColumn("next_idx", F.lead("frame_idx").over(line)).withColumn("next_luma", F.lead("luma").over(line)).where("next_idx is not null")
    m = motion.direction(views.mvs(spark, d), "past")
    small = m.select("frame_id", "mv_idx", (F.col("dst_x") % 8).alias("dst_x"), (F.col("dst_y") % 8).alias("dst_y"), F.lit(4).alias("w"), F.lit(4).alias("h"), "motion_x", "motion_y", "motion_scale")
    holes = motion.motion_signal(small, 8, 8).select(F.col("frame_id").alias("next_idx"), "intra")
    hole = F.coalesce("intra", F.lit(1.0))
    own = f.join(holes, "next_idx", "left").withColumn("made", (F.abs(F.col("next_luma") - F.col("luma")) <= 5.0) & (hole <= 0.75))
    return own.groupBy("scene").agg(F.count_if("made").alias("made"), F.count_if(~F.col("made")).alias("copied"), F.sum(F.when(F.col("made"), (F.col("luma") + F.col("next_luma")) / 2).otherwise(F.col("luma"))).alias("total"))


def detail_drift(spark: SparkSession, d: str) -> DataFrame:
    """Sharpness by distance from the last anchor, with propagation alone and with a cache every fourth frame, and each curve's half-life."""
    sharp = tiles.var_laplacian(views.tiles(spark, d))
    k = F.row_number().over(Window.partitionBy("scene").orderBy("frame_idx")) - 1
    own = sharp.withColumn("k", k)
    rows = own.select("scene", F.explode(F.array(F.struct(F.lit("propagated").alias("model"), (F.col("k") % 12).alias("dist")), F.struct(F.lit("cached").alias("model"), (F.col("k") % 4).alias("dist")))).alias("m"), "sharpness")
    curve = rows.groupBy("m.model", "m.dist").agg(F.avg(F.col("sharpness") / (1 + F.col("m.dist"))).alias("gap"))
    return stats.half_life(curve, ["model"])


def region_table(spark: SparkSession, d: str) -> DataFrame:
    """Three blends of tiles with their plate: mean value and temporal change by variant and region."""
    plate = plate_median(spark, d).select("scene", "pos", F.col("value"))
    both = views.tiles(spark, d).join(plate, ["scene", "pos"]).withColumn("region", F.when(F.col("pos") < 32, "upper").otherwise("lower"))
    aware = F.when(F.col("region") == "upper", F.col("luma")).otherwise((F.col("luma") + F.col("value")) / 2)
    options = {"light": F.col("value"), "heavy": F.col("luma"), "aware": aware}
    rows = both.withColumn("v", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("value")) for n, e in options.items()]))).select("scene", "frame_idx", "pos", "region", "v.variant", F.col("v.value").alias("x"))
    change = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("scene", "pos", "variant").orderBy("frame_idx")))
    return rows.withColumn("change", change).groupBy("variant", "region").agg(F.avg("x").alias("mean"), F.avg("change").alias("change"), F.count("change").alias("n"))


def residual_add(spark: SparkSession, d: str) -> DataFrame:
    """Each tile from the one before it in its scene: moved along its vector, plus the residual in whole steps."""
    own = tiles.residual_added(views.tiles(spark, d), frame_vectors(spark, d))
    return own.groupBy("scene", "frame_idx").agg(F.sum("value").cast("bigint").alias("total"), F.max(F.abs(F.col("luma") - F.col("value"))).alias("worst"))


def channel_layout(spark: SparkSession, d: str) -> DataFrame:
    """Samples from rows to columns, from doubles to bytes and to the range from 0 to 1, and back: the digest of each form."""
    byte = F.floor("luma").cast("int")
    t = views.tiles(spark, d).select("scene", "frame_idx", "pos", byte.alias("b"), (F.col("pos") % 8 * 8 + F.floor(F.col("pos") / 8)).cast("int").alias("turned"))
    back = F.bround(F.col("b") / 255.0 * 255.0).cast("int")
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "b"))), lambda r: r["b"].cast("string")), ",")
    return t.groupBy("scene", "frame_idx").agg(F.md5(joined("pos")).alias("by_row"), F.md5(joined("turned")).alias("by_column"), F.count_if(back != F.col("b")).alias("lost"))


def deblocked_steps(spark: SparkSession, d: str) -> DataFrame:
    """Tiles with small steps across a grid of four spread over the two samples beside them: how far samples move, and their sum."""
    own = planes(spark, d).select("scene", "frame_idx", "plane", arrow.plane_map(lambda x: kernels.deblocked(x, 4, 0.5, 24.0), 8)("plane").alias("smooth"))
    gaps = F.transform(F.arrays_zip("plane", "smooth"), lambda v: F.abs(v["smooth"] - v["plane"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return own.select("scene", "frame_idx", (total(gaps) / 64).alias("moved"), F.array_max(gaps).alias("most"), total(F.col("smooth")).alias("total"))


def fg_gate(spark: SparkSession, d: str) -> DataFrame:
    """Foreground cells of each tile at half its size as a matte: at least a limit, grown by an ellipse of five cells."""
    g = tiles.gated(views.tiles(spark, d), 140.0).withColumn("soft", columns.ramp(F.col("luma"), 100.0, 200.0))
    return g.groupBy("scene", "frame_idx").agg(F.count_if("on").alias("on"), F.count_if("grown").alias("grown"), F.sum("soft").alias("soft"))


def sampled_scan(spark: SparkSession, d: str) -> DataFrame:
    """A window of each clip's frames and how many of them are distinct by type and level: the scan is cut by the filter."""
    own = readers.frame_window(views.frames(spark, d), 8, 24)
    return own.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ptype").alias("types"), F.count_distinct(F.floor(F.col("luma") / 16)).alias("levels"), F.min("frame_idx").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        probed, clip_catalog, picture_types, packed_records, frames_with_motion, json_results, rounding_report, plate_guard, deblock_gates, best_modes, layered_costs, beta_select, occluded_vectors,
        colour_clamp, rgb_luma, masked_sharpness, band_change, background_psnr, leaf_patches, registered_change, best_crops, plate_samples, blend_family, beta_maps, layered_frames, legacy_chain,
        bench_table, doubled_frames, muxed, output_check, soft_patches, chroma_cuts, combined_cuts,
        hole_shares, chunk_state, interp_guard, detail_drift, region_table, residual_add, channel_layout, deblocked_steps, fg_gate, sampled_scan,
    )
}

TILES, FRAMES, MVS = f"WITH {views.TILES}", f"WITH {views.FRAMES}", f"WITH {views.MVS}"
RAMP = "least(greatest(({} - {}) / ({} - {}), 0), 1)"
_ramp = lambda v, lo, hi: RAMP.format(v, lo, hi, lo)
BLOCKS = TILES + """, st AS (SELECT *, abs(lead(luma) OVER (PARTITION BY scene, frame_idx, pos // 8 ORDER BY pos) - luma) AS step FROM tiles),
bl AS (SELECT scene, frame_idx, avg(step) FILTER (WHERE (pos % 8) % 4 = 3) / (avg(step) + 1e-6) AS blockiness FROM st GROUP BY ALL),
lp AS (SELECT *, lag(luma) OVER w + lead(luma) OVER w + lag(luma, 8) OVER w + lead(luma, 8) OVER w - 4 * luma AS lap FROM tiles WINDOW w AS (PARTITION BY scene, frame_idx ORDER BY pos)),
sh AS (SELECT scene, frame_idx, var_pop(lap) FILTER (WHERE pos % 8 BETWEEN 1 AND 6 AND pos // 8 BETWEEN 1 AND 6) AS sharpness FROM lp GROUP BY ALL),
bs AS (SELECT * FROM bl JOIN sh USING (scene, frame_idx))
"""
GUARD = P3.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT t.scene, t.frame_idx, avg((t.luma - p.value) * (t.luma - p.value)) AS mse FROM tiles t JOIN plate p USING (scene, pos) GROUP BY t.scene, t.frame_idx),
q AS (SELECT *, CASE WHEN mse <= 1e-12 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0 / mse) END AS psnr FROM e),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) AS k FROM q),
guard AS (
  SELECT scene, frame_idx, k, NOT isinf(psnr) AND psnr < 4 AS bad, CASE WHEN isinf(psnr) OR psnr < 4 THEN NULL ELSE psnr END::DOUBLE AS base FROM n WHERE k = 1
  UNION ALL
  SELECT scene, frame_idx, k, bad, CASE WHEN bad OR isinf(psnr) THEN base WHEN base IS NULL THEN psnr ELSE 0.3::DOUBLE * psnr + (1.0::DOUBLE - 0.3::DOUBLE) * base END
  FROM (SELECT n.scene, n.frame_idx, n.k, n.psnr, guard.base, NOT isinf(n.psnr) AND (n.psnr < 4 OR coalesce(n.psnr < guard.base - 0.5::DOUBLE, false)) AS bad
        FROM guard JOIN n ON n.scene = guard.scene AND n.k = guard.k + 1))
"""

ORACLE_SQL = {
    "probed": """WITH o AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 24000 WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 25 END AS num, CASE o_orderkey % 4 WHEN 0 THEN 1001 WHEN 2 THEN 2 ELSE 1 END AS den FROM orders)
SELECT o_orderkey, num, den, CAST(least(CASE WHEN o_orderkey % 3 = 0 AND o_custkey > 0 THEN o_custkey WHEN o_orderkey % 5 = 0 THEN 0 ELSE round_even(o_custkey / 8.0 * (num / den), 0) END, 900) AS BIGINT) AS n_frames FROM o""",
    "clip_catalog": """WITH f AS (SELECT p_name AS name, p_partkey AS folder_rank, p_size * 25 AS n_frames, 25.0::DOUBLE AS fps, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part),
m AS (SELECT unnest(['instant', 'layered', 'quality']) AS mode, unnest([130.0, 1400.0, 2900.0]::DOUBLE[]) AS ms_frame)
SELECT name, folder_rank, n_frames, fps, mode, ms_frame, CAST(round_even(n_frames * ms_frame / 1000, 0) AS BIGINT) AS seconds, n_frames / fps AS duration FROM f, m WHERE k = 1""",
    "picture_types": """SELECT CASE l_linenumber % 5 WHEN 1 THEN 'I' WHEN 2 THEN 'P' WHEN 3 THEN 'B' ELSE '?' END AS ptype, count(*) AS n, count(DISTINCT l_orderkey) AS frames, count(DISTINCT (l_suppkey, l_orderkey)) AS places FROM lineitem GROUP BY 1""",
    "packed_records": MVS + "SELECT frame_id, mv_idx, source, w, dst_x, dst_y, motion_x, motion_y FROM mvs",
    "frames_with_motion": MVS + """, g AS (SELECT frame_id, count(*) AS n, arg_min(motion_x, mv_idx) AS first_x, arg_max(motion_x, mv_idx) AS last_x FROM mvs WHERE w = 16 GROUP BY frame_id)
SELECT o_orderkey AS frame_id, CAST(coalesce(n, 0) AS INTEGER) AS n, first_x, last_x FROM orders LEFT JOIN g ON g.frame_id = o_orderkey WHERE o_orderkey >= 100 AND o_orderkey < 4100""",
    "json_results": f"WITH {views.SCORES} SELECT win, model, count(*) AS n, avg(metric) AS mean FROM scores WHERE doc_id % 10 <> 0 GROUP BY win, model",
    "rounding_report": """WITH v AS (SELECT DISTINCT l_linenumber * l_suppkey / 4.0::DOUBLE - 6 AS v FROM lineitem)
SELECT v, round_even(v, 0) AS even, CAST(floor(v + 0.5) AS BIGINT) AS half_up, CAST(trunc(v) AS BIGINT) AS cut, CAST(floor(v) AS BIGINT) AS down, CAST(ceil(v) AS BIGINT) AS up FROM v""",
    "plate_guard": GUARD + "SELECT scene, frame_idx, bad FROM guard",
    "deblock_gates": BLOCKS + """SELECT scene, frame_idx, true AS always, CASE WHEN frame_idx % 7 = 0 THEN blockiness >= 1.05 ELSE frame_idx % 52 >= 30 END AS by_qp, blockiness >= 1.05 AS by_step,
  CASE WHEN frame_idx % 7 = 0 THEN blockiness >= 1.05 ELSE frame_idx % 52 >= 30 END AND sharpness / 50000.0 < 0.5 AS guarded FROM bs""",
    "best_modes": FRAMES + """, m AS (SELECT clip_id AS clip, max(luma) FILTER (WHERE ptype = 'I') AS lt, max(luma) FILTER (WHERE ptype = 'P') AS qt, max(luma) FILTER (WHERE ptype = 'B') AS it,
  2 * min(luma) FILTER (WHERE ptype = 'P') AS qm, 2 * min(luma) FILTER (WHERE ptype = 'B') AS im FROM frames GROUP BY clip_id)
SELECT clip, CASE WHEN lt IS NOT NULL AND clip % 3 <> 0 AND coalesce(lt, 9) <= coalesce(qt, 9) THEN 'layered' WHEN coalesce(im, 1e9) <= 42 AND coalesce(it, 9) <= 1.5 * coalesce(qt, 9) THEN 'instant'
  WHEN qm IS NOT NULL THEN 'quality' ELSE 'instant' END AS best FROM m""",
    "layered_costs": TILES + """, s AS (SELECT scene, count(DISTINCT frame_idx) AS n FROM tiles GROUP BY scene)
SELECT scene, refresh, n, 4.0 + 300.0 / refresh + 42.0 + 6.5 + 3.25 + 900.0 / n AS ms FROM s, (SELECT unnest([1, 2, 6]) AS refresh)""",
    "beta_select": BLOCKS + f"SELECT scene, frame_idx, 0.85 - 0.15 * {_ramp('sharpness', 5000.0, 60000.0)} * {_ramp('blockiness', 0.8, 1.3)} AS beta, 1.0 - {_ramp('(frame_idx % 9)::DOUBLE', 1.5, 6.0)} AS gate FROM bs",
    "occluded_vectors": MVS + """, p AS (SELECT frame_id, motion_x / 4.0 AS dx, motion_y / 4.0 AS dy, lead(motion_x / 4.0) OVER w AS bx, lead(motion_y / 4.0) OVER w AS b FROM mvs WINDOW w AS (PARTITION BY frame_id ORDER BY mv_idx))
SELECT frame_id, count(*) AS n, count(*) FILTER (WHERE (dx + bx) * (dx + bx) + (dy + b) * (dy + b) > 0.01::DOUBLE * (dx * dx + dy * dy + bx * bx + b * b) + 0.5) AS occluded FROM p WHERE bx IS NOT NULL GROUP BY frame_id""",
    "colour_clamp": TILES + """, h AS (SELECT *, lag(luma) OVER (PARTITION BY scene, pos ORDER BY frame_idx) AS history FROM tiles),
b AS (
  SELECT a.scene, a.frame_idx, a.pos, any_value(a.history) AS history, avg(n.luma) AS m, sqrt(greatest(avg(n.luma * n.luma) - avg(n.luma) * avg(n.luma), 0)) AS s
  FROM h a JOIN tiles n ON n.scene = a.scene AND n.frame_idx = a.frame_idx AND abs(n.pos % 8 - a.pos % 8) <= 1 AND abs(n.pos // 8 - a.pos // 8) <= 1
  WHERE a.history IS NOT NULL GROUP BY a.scene, a.frame_idx, a.pos),
c AS (SELECT *, round_even(least(greatest(history, m - 1.5 * s), m + 1.5 * s), 0) AS held FROM b)
SELECT scene, frame_idx, count(*) FILTER (WHERE abs(held - history) > 1) AS moved, min(held) AS low, max(held) AS high FROM c GROUP BY scene, frame_idx""",
    "rgb_luma": TILES + """, n AS (SELECT *, lead(luma, 1) OVER w AS g, lead(luma, 2) OVER w AS b FROM tiles WINDOW w AS (PARTITION BY scene, frame_idx ORDER BY pos))
SELECT scene, frame_idx, avg(luma * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS y FROM n WHERE pos % 3 = 0 AND b IS NOT NULL GROUP BY scene, frame_idx""",
    "masked_sharpness": BLOCKS + """, v AS (SELECT scene, frame_idx, var_pop(lap) FILTER (WHERE (frame_idx + pos) % 2 = 0 AND pos % 8 BETWEEN 1 AND 6 AND pos // 8 BETWEEN 1 AND 6) AS sharpness FROM lp GROUP BY ALL)
SELECT scene, avg(sharpness) AS mean, max(sharpness) AS most, count(sharpness) AS n FROM v GROUP BY scene""",
    "band_change": TILES + """, b AS (SELECT *, greatest(abs(2 * (pos % 8) - 7), abs(2 * (pos // 8) - 7)) AS far, abs(luma - lag(luma) OVER (PARTITION BY scene, pos ORDER BY frame_idx)) AS change FROM tiles)
SELECT scene, CASE WHEN far <= 2 THEN 'core' WHEN far <= 4 THEN 'ring' ELSE 'rim' END AS band, avg(change) AS change, count(change) AS n FROM b GROUP BY ALL""",
    "background_psnr": P3 + f""", e AS (SELECT t.scene, t.frame_idx, avg((t.luma - p.value) * (t.luma - p.value)) FILTER (WHERE NOT ({GATE}) AND pos % 5 <> 0) AS mse, count(*) FILTER (WHERE NOT ({GATE}) AND pos % 5 <> 0) AS n
  FROM tiles t JOIN plate p USING (scene, pos) GROUP BY t.scene, t.frame_idx)
SELECT scene, frame_idx, n, CASE WHEN n < 17 THEN 'inf'::DOUBLE WHEN mse <= 1e-6 THEN 99.0 ELSE 10 * log10(65025.0 / mse) END AS psnr FROM e""",
    "leaf_patches": P3 + """, r AS (SELECT t.scene, t.frame_idx, t.luma > 160 AS hole, floor(t.luma) AS heavy, trunc(p.value) AS cheap FROM tiles t JOIN plate p USING (scene, pos)),
s AS (SELECT *, frame_idx % 5 <> 0 AND avg(hole::INT) OVER (PARTITION BY scene, frame_idx) > 0.15 AS use FROM r)
SELECT scene, frame_idx, count(*) FILTER (WHERE use AND hole) AS patched, sum(CASE WHEN use AND hole THEN heavy ELSE cheap END) AS total FROM s GROUP BY scene, frame_idx""",
    "registered_change": TILES + """, k AS (SELECT scene, frame_idx, lag(frame_idx) OVER (PARTITION BY scene ORDER BY frame_idx) AS bef FROM (SELECT DISTINCT scene, frame_idx FROM tiles))
SELECT a.scene, a.frame_idx, avg(abs(a.luma - b.luma)) AS change, count(*) AS n FROM tiles a JOIN k ON k.scene = a.scene AND k.frame_idx = a.frame_idx
JOIN tiles b ON b.scene = a.scene AND b.frame_idx = k.bef AND b.pos = a.pos - 2 AND a.pos % 8 >= 2 GROUP BY a.scene, a.frame_idx""",
    "best_crops": BLOCKS + """, c AS (SELECT y, x FROM (SELECT unnest([0, 2, 4]) AS y), (SELECT unnest([0, 2, 4]) AS x)),
v AS (SELECT l.scene, l.frame_idx, c.y, c.x, var_pop(lap) AS sharpness FROM lp l JOIN c ON l.pos // 8 BETWEEN c.y + 1 AND c.y + 2 AND l.pos % 8 BETWEEN c.x + 1 AND c.x + 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scene, frame_idx ORDER BY sharpness DESC, y, x) AS k FROM v)
SELECT scene, frame_idx, y, x, sharpness FROM r WHERE k = 1""",
    "plate_samples": P3 + """, f AS (SELECT DISTINCT scene, frame_idx, frame_idx % 3 - 1 AS dx, frame_idx % 2 AS dy FROM tiles),
s AS (SELECT f.scene, f.frame_idx, g.pos, CAST(least(greatest(g.pos // 8 + dy, 0), 7) * 8 + least(greatest(g.pos % 8 + dx, 0), 7) AS INTEGER) AS at FROM f, (SELECT unnest(range(64)) AS pos) g)
SELECT s.scene, s.frame_idx, sum(p.value) AS total, arg_max(p.value, s.pos) AS corner FROM s JOIN plate p ON p.scene = s.scene AND p.pos = s.at GROUP BY s.scene, s.frame_idx""",
    "blend_family": P3 + """, r AS (SELECT t.scene, t.frame_idx, t.pos, floor(t.luma) AS a, trunc(p.value) AS b FROM tiles t JOIN plate p USING (scene, pos)),
h AS (SELECT *, a - avg(a) OVER w AS ha, b - avg(b) OVER w AS hb FROM r WINDOW w AS (PARTITION BY scene, frame_idx, pos // 8 ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT scene, frame_idx, sum(least(greatest(round_even(a + 1.25 * (b - a), 0), 0), 255)) AS linear,
  sum(least(greatest(round_even(CASE WHEN sign(ha) = sign(hb) THEN a + 0.75 * hb ELSE a END, 0), 0), 255)) AS agreeing FROM h GROUP BY scene, frame_idx""",
    "beta_maps": P3 + f""", t AS (SELECT t.scene, t.frame_idx, t.pos, t.luma, abs(t.luma - p.value) AS gap FROM tiles t JOIN plate p USING (scene, pos)),
d AS (SELECT *, stddev_pop(luma) OVER w AS dev, stddev_pop(gap) OVER w AS dev2 FROM t WINDOW w AS (PARTITION BY scene, frame_idx, pos // 8 ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
s AS (SELECT scene, pos, avg(dev) AS tx, avg(dev2) AS dg, avg(gap) AS dt FROM d GROUP BY scene, pos)
SELECT scene, pos, 0.3 + 0.7 * {_ramp('tx', 8.0, 22.0)} AS by_texture, 1 - (1 - {_ramp('tx', 8.0, 22.0)}) * {_ramp('dt', 10.0, 30.0)} * 0.7 AS by_degradation,
  1 - (1 - {_ramp('tx', 8.0, 22.0)}) * (1 - {_ramp('dg', 4.0, 14.0)}) * 0.7 AS by_disagreement FROM s""",
    "layered_frames": GUARD + """, l AS (SELECT t.scene, t.frame_idx, NOT g.bad AS layered, CASE WHEN g.bad THEN floor(t.luma) ELSE trunc((t.pos % 5) / 4.0::DOUBLE * floor(t.luma) + (1.0::DOUBLE - (t.pos % 5) / 4.0::DOUBLE) * trunc(p.value)) END AS value
  FROM tiles t JOIN plate p USING (scene, pos) JOIN guard g ON g.scene = t.scene AND g.frame_idx = t.frame_idx)
SELECT scene, frame_idx, bool_or(layered) AS layered, CAST(sum(value) AS BIGINT) AS total FROM l GROUP BY scene, frame_idx""",
    "legacy_chain": FRAMES + """, a AS (SELECT *, lag(frame_idx) OVER w AS shown, max(CASE WHEN ptype <> 'B' THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref,
  max(CASE WHEN ptype = 'I' OR frame_idx = 0 THEN frame_idx END) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS anchor,
  sum((ptype <> 'B')::INT) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS b FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
c AS (SELECT *, frame_idx - anchor AS hops_shown, b - first_value(b) OVER (PARTITION BY clip_id, anchor ORDER BY frame_idx) AS hops_ref FROM a)
SELECT clip_id, count(*) AS n, count(*) FILTER (WHERE shown IS DISTINCT FROM ref) AS differing, CAST(sum(hops_shown) AS BIGINT) AS hops_shown, CAST(sum(hops_ref) AS BIGINT) AS hops_ref FROM c GROUP BY clip_id""",
    "bench_table": FRAMES + """, c AS (SELECT clip_id, frame_idx // 8 AS chunk, sum(luma) AS b, sum(luma / 4) AS a, max(luma) AS q FROM frames GROUP BY ALL),
r AS (SELECT 'before' AS variant, b AS ms, 0.0::DOUBLE AS delta FROM c UNION ALL SELECT 'after', a, (q - 1) - q FROM c)
SELECT variant, count(*) AS n, avg(ms) AS mean_ms, median(ms) AS median_ms, quantile_cont(ms, 0.9) AS p90_ms, avg(delta) AS quality_delta FROM r GROUP BY variant""",
    "doubled_frames": FRAMES + """, a AS (SELECT clip_id, frame_idx, luma, lag(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS lft FROM frames),
b AS (SELECT * FROM a UNION ALL SELECT clip_id, max(frame_idx) + 1, arg_max(luma, frame_idx), max(frame_idx) FROM a GROUP BY clip_id)
SELECT clip_id, count(*) AS n, CAST(sum(lft) AS BIGINT) AS left_sum, max(frame_idx) AS last, arg_max(luma, frame_idx) AS last_luma FROM b GROUP BY clip_id""",
    "muxed": f"WITH {views.PACKETS}, p AS (SELECT rank, t / 1e6::DOUBLE AS t FROM packets) SELECT rank, count(*) AS n, max(t) AS last, min(t) AS first FROM p WHERE rank = 0 OR t < 86400 * 90 / 25.0 GROUP BY rank",
    "output_check": FRAMES + """, n AS (SELECT clip_id AS clip, count(*) AS n FROM frames GROUP BY clip_id)
SELECT clip, clip % 7 <> 0 AS count_ok, clip % 11 <> 0 OR n = 1 AS size_ok, clip % 4 = 0 OR clip % 3 <> 0 AS sync_ok FROM n""",
    "soft_patches": P3.replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT t.scene, t.frame_idx, t.pos, t.luma, trunc(p.value) AS cheap, floor(t.luma) AS heavy FROM tiles t JOIN plate p USING (scene, pos)),
n AS (SELECT *, row_number() OVER l - 1 AS k, abs(luma - lag(luma) OVER l) AS gap, avg((luma > 160)::INT) OVER (PARTITION BY scene, frame_idx, pos // 8 ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS feather
  FROM r WINDOW l AS (PARTITION BY scene, pos ORDER BY frame_idx)),
mm AS MATERIALIZED (SELECT *, k % 12 = 0 AS anchor, k % 12 = 0 OR k % 4 <> 3 AS run FROM n),
e AS (SELECT scene, pos, k, heavy - cheap AS ema FROM mm m WHERE k = 0
  UNION ALL SELECT m.scene, m.pos, m.k, CASE WHEN m.anchor THEN m.heavy - m.cheap WHEN NOT m.run THEN e.ema ELSE 0.15::DOUBLE * (m.heavy - m.cheap) + 0.85::DOUBLE * e.ema END
  FROM e JOIN mm m ON m.scene = e.scene AND m.pos = e.pos AND m.k = e.k + 1),
s AS (SELECT m.scene, m.frame_idx, NOT anchor AND run AS patched, cheap, ema, least(greatest(0.6 * feather * least(greatest((gap - 10) / 50.0::DOUBLE, 0), 1), 0), 1) AS a FROM mm m JOIN e ON e.scene = m.scene AND e.pos = m.pos AND e.k = m.k)
SELECT scene, frame_idx, count(*) FILTER (WHERE patched) AS patched, sum(CASE WHEN patched THEN least(greatest((1 - a) * (cheap + 4) + a * (cheap + ema), 0), 255) ELSE cheap + 4 END) AS total FROM s GROUP BY scene, frame_idx""",
    "chroma_cuts": f"""WITH RECURSIVE {views.FRAMES},
n AS MATERIALIZED (SELECT clip_id, frame_idx, ptype, luma / 8 AS y, abs(luma - 250) / 2 + CASE WHEN frame_idx % 29 = 28 THEN 150.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM frames),
f AS (
  SELECT clip_id, frame_idx, y, c, CAST(NULL AS DOUBLE) AS base, CAST(NULL AS DOUBLE) AS cbase, frame_idx AS last, CAST(NULL AS DOUBLE) AS diff, false AS is_cut, CAST(NULL AS VARCHAR) AS fired_by FROM n WHERE frame_idx = 0
  UNION ALL
  SELECT clip_id, frame_idx, y, c, CASE WHEN cut THEN NULL WHEN base IS NULL THEN d ELSE 0.3::DOUBLE * d + (1.0::DOUBLE - 0.3::DOUBLE) * base END,
    CASE WHEN cut THEN NULL WHEN cbase IS NULL THEN dc ELSE 0.3::DOUBLE * dc + (1.0::DOUBLE - 0.3::DOUBLE) * cbase END, CASE WHEN cut THEN frame_idx ELSE last END, d, cut, fired
  FROM (SELECT *, fired IS NOT NULL AND frame_idx - last >= 24 AS cut FROM (SELECT *,
    CASE WHEN d > 60 THEN 'absolute' WHEN ptype = 'I' AND d > 45 THEN 'intra' WHEN base IS NOT NULL AND d > 40 AND d > 8 * base THEN 'relative'
      WHEN dc > 1.1::DOUBLE * d AND (dc > 60 OR (cbase IS NOT NULL AND dc > 22 AND dc > 6 * cbase)) THEN 'chroma' END AS fired
    FROM (SELECT n.*, f.base, f.cbase, f.last, abs(n.y - f.y) AS d, abs(n.c - f.c) AS dc FROM f JOIN n ON n.clip_id = f.clip_id AND n.frame_idx = f.frame_idx + 1))))
SELECT clip_id, frame_idx, diff, is_cut, fired_by FROM f WHERE fired_by IS NOT NULL""",
    "combined_cuts": f"""WITH RECURSIVE {views.FRAMES},
s AS (SELECT clip_id, frame_idx, ptype, coalesce(abs(luma / 8 - lag(luma / 8) OVER l), 0) AS dl, coalesce(abs(luma % 64 - lag(luma % 64) OVER l), 0) AS dc FROM frames WINDOW l AS (PARTITION BY clip_id ORDER BY frame_idx)),
n AS MATERIALIZED (SELECT clip_id, frame_idx, ptype, w, floor(dl + w * dc) AS d FROM s, (SELECT unnest([0, 1, 2]) AS w)),
f AS (
  SELECT clip_id, w, frame_idx, CAST(NULL AS DOUBLE) AS base, frame_idx AS last, CAST(NULL AS DOUBLE) AS diff, false AS is_cut FROM n WHERE frame_idx = 0
  UNION ALL
  SELECT clip_id, w, frame_idx, CASE WHEN cut THEN NULL WHEN base IS NULL THEN d ELSE 0.3::DOUBLE * d + (1.0::DOUBLE - 0.3::DOUBLE) * base END, CASE WHEN cut THEN frame_idx ELSE last END, d, cut
  FROM (SELECT n.*, f.base, f.last, (n.d > 60 OR (n.ptype = 'I' AND n.d > 45) OR (f.base IS NOT NULL AND n.d > 40 AND n.d > 8 * f.base)) AND n.frame_idx - f.last >= 24 AS cut
        FROM f JOIN n ON n.clip_id = f.clip_id AND n.w = f.w AND n.frame_idx = f.frame_idx + 1))
SELECT clip_id AS clip, w, count(*) FILTER (WHERE is_cut) AS cuts, max(diff) AS most FROM f GROUP BY clip_id, w""",
    "hole_shares": RASTER + """, n AS (SELECT frame_id, 1.0::DOUBLE - count(*) / 2048.0::DOUBLE AS intra FROM flow GROUP BY frame_id)
SELECT CAST(frame_id % 20 AS INTEGER) AS clip, avg(intra) AS hole_frac, count(*) FILTER (WHERE intra > 0.9) AS over, count(*) AS n FROM n GROUP BY 1""",
    "chunk_state": CUTS + """, g AS (SELECT *, is_cut OR ptype = 'I' AS again FROM f),
e AS (SELECT clip_id, frame_idx, luma AS ema, CAST(NULL AS DOUBLE) AS carried FROM g WHERE frame_idx = 0
  UNION ALL SELECT g.clip_id, g.frame_idx, CASE WHEN g.again THEN g.luma ELSE 0.25::DOUBLE * g.luma + 0.75::DOUBLE * e.ema END, e.ema FROM e JOIN (SELECT * FROM g) g ON g.clip_id = e.clip_id AND g.frame_idx = e.frame_idx + 1)
SELECT clip_id, frame_idx, carried, ema FROM e WHERE frame_idx % 16 = 0""",
    "interp_guard": f"""WITH {views.TILES}, {views.MVS}, f AS (SELECT scene, frame_idx, avg(luma) AS luma FROM tiles GROUP BY ALL),
p AS (SELECT *, lead(frame_idx) OVER l AS next_idx, lead(luma) OVER l AS next_luma FROM f WINDOW l AS (PARTITION BY scene ORDER BY frame_idx)),
h AS (
  SELECT frame_id AS next_idx, 1.0 - count(DISTINCT k) / 64.0::DOUBLE AS hole FROM (SELECT *, unnest(range(64)) AS k FROM mvs WHERE source < 0)
  WHERE k % 8 >= dst_x % 8 - 2 AND k % 8 < dst_x % 8 + 2 AND k // 8 >= dst_y % 8 - 2 AND k // 8 < dst_y % 8 + 2 GROUP BY frame_id),
m AS (SELECT p.*, abs(next_luma - luma) <= 5 AND coalesce(hole, 1) <= 0.75 AS made FROM p LEFT JOIN h USING (next_idx) WHERE next_idx IS NOT NULL)
SELECT scene, count(*) FILTER (WHERE made) AS made, count(*) FILTER (WHERE NOT made) AS copied, sum(CASE WHEN made THEN (luma + next_luma) / 2 ELSE luma END) AS total FROM m GROUP BY scene""",
    "detail_drift": BLOCKS + """, k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame_idx) - 1 AS k FROM sh),
r AS (SELECT 'propagated' AS model, k % 12 AS dist, sharpness FROM k UNION ALL SELECT 'cached', k % 4, sharpness FROM k),
c AS (SELECT model, dist, avg(sharpness / (1 + dist)) AS gap FROM r GROUP BY ALL),
p AS (SELECT *, first_value(gap) OVER w AS g0, lag(dist) OVER w AS px, lag(gap) OVER w AS py FROM c WINDOW w AS (PARTITION BY model ORDER BY dist)),
h AS (SELECT *, CASE WHEN px IS NULL OR py = gap THEN dist ELSE px + (py - g0 / 2) / (py - gap) * (dist - px) END AS hit FROM p)
SELECT model, CASE WHEN first(g0) <= 0 THEN NULL ELSE coalesce(arg_min(hit, dist) FILTER (WHERE gap <= g0 / 2), max(dist))::DOUBLE END AS half_life FROM h GROUP BY model""",
    "region_table": P3 + """, b AS (SELECT t.scene, t.frame_idx, t.pos, t.luma, p.value, CASE WHEN t.pos < 32 THEN 'upper' ELSE 'lower' END AS region FROM tiles t JOIN plate p USING (scene, pos)),
r AS (SELECT *, unnest(['light', 'heavy', 'aware']) AS variant, unnest([value, luma, CASE WHEN region = 'upper' THEN luma ELSE (luma + value) / 2 END]) AS x FROM b),
c AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY scene, pos, variant ORDER BY frame_idx)) AS change FROM r)
SELECT variant, region, avg(x) AS mean, avg(change) AS change, count(change) AS n FROM c GROUP BY variant, region""",
    "residual_add": f"""WITH {views.TILES}, {views.MVS}, {VECTORS},
o AS (SELECT scene, frame_idx, lag(frame_idx) OVER (PARTITION BY scene ORDER BY frame_idx) AS before FROM (SELECT DISTINCT scene, frame_idx FROM tiles)),
b AS (SELECT o.scene, o.frame_idx, t.pos, t.luma FROM o JOIN tiles t ON t.scene = o.scene AND t.frame_idx = o.before),
s AS (SELECT b.scene, b.frame_idx, b.pos, least(greatest(b.pos % 8 + coalesce(v.dx, 0), 0), 7) AS sx, least(greatest(b.pos // 8 + coalesce(v.dy, 0), 0), 7) AS sy FROM b LEFT JOIN v USING (frame_idx)),
q AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM s),
k AS (SELECT *, unnest([0, 1, 0, 1]) AS ox, unnest([0, 0, 1, 1]) AS oy FROM q),
w AS (SELECT scene, frame_idx, pos, CAST(least(y0 + oy, 7) * 8 + least(x0 + ox, 7) AS INTEGER) AS at, (CASE WHEN ox = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN oy = 1 THEN fy ELSE 1 - fy END) AS weight FROM k),
m AS (SELECT w.scene, w.frame_idx, w.pos, sum(w.weight * b.luma) AS moved FROM w JOIN b ON b.scene = w.scene AND b.frame_idx = w.frame_idx AND b.pos = w.at GROUP BY ALL),
r AS (SELECT t.scene, t.frame_idx, t.luma, trunc(least(greatest(moved + floor((t.luma - moved) / 2) * 2, 0), 255)) AS value FROM m JOIN tiles t USING (scene, frame_idx, pos))
SELECT scene, frame_idx, CAST(sum(value) AS BIGINT) AS total, max(abs(luma - value)) AS worst FROM r GROUP BY scene, frame_idx""",
    "channel_layout": TILES + """, b AS (SELECT scene, frame_idx, pos, CAST(floor(luma) AS INTEGER) AS b, pos % 8 * 8 + pos // 8 AS turned FROM tiles)
SELECT scene, frame_idx, md5(string_agg(b::VARCHAR, ',' ORDER BY pos)) AS by_row, md5(string_agg(b::VARCHAR, ',' ORDER BY turned)) AS by_column, count(*) FILTER (WHERE round_even(b / 255.0::DOUBLE * 255.0, 0) <> b) AS lost FROM b GROUP BY scene, frame_idx""",
    "deblocked_steps": TILES + """, n AS (SELECT *, lag(luma, 8) OVER w AS u, lead(luma, 8) OVER w AS d FROM tiles WINDOW w AS (PARTITION BY scene, frame_idx ORDER BY pos)),
a AS (SELECT *, CASE WHEN pos // 8 = 4 AND abs(luma - u) <= 24 THEN luma - (luma - u) / 4 WHEN pos // 8 = 3 AND abs(d - luma) <= 24 THEN luma + (d - luma) / 4 ELSE luma END AS v FROM n),
b AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM a WINDOW w AS (PARTITION BY scene, frame_idx ORDER BY pos)),
c AS (SELECT *, CASE WHEN pos % 8 = 4 AND abs(v - l) <= 24 THEN v - (v - l) / 4 WHEN pos % 8 = 3 AND abs(r - v) <= 24 THEN v + (r - v) / 4 ELSE v END AS s FROM b)
SELECT scene, frame_idx, avg(abs(s - luma)) AS moved, max(abs(s - luma)) AS most, sum(s) AS total FROM c GROUP BY scene, frame_idx""",
    "fg_gate": TILES + """, c AS (SELECT scene, frame_idx, CAST((pos // 16) * 4 + (pos % 8) // 2 AS INTEGER) AS cell, avg(luma) AS luma FROM tiles GROUP BY ALL),
o AS (SELECT *, luma >= 140 AS o FROM c),
g AS (
  SELECT a.scene, a.frame_idx, a.cell, any_value(a.luma) AS luma, bool_or(n.cell = a.cell AND n.o) AS o, bool_or(n.o) AS grown
  FROM o a JOIN o n ON n.scene = a.scene AND n.frame_idx = a.frame_idx AND (n.cell % 4 - a.cell % 4) * (n.cell % 4 - a.cell % 4) + (n.cell // 4 - a.cell // 4) * (n.cell // 4 - a.cell // 4) <= 4
  GROUP BY a.scene, a.frame_idx, a.cell)
SELECT scene, frame_idx, count(*) FILTER (WHERE o) AS "on", count(*) FILTER (WHERE grown) AS grown, sum(least(greatest((luma - 100) / 100.0, 0), 1)) AS soft FROM g GROUP BY scene, frame_idx""",
    "sampled_scan": FRAMES + " SELECT clip_id, count(*) AS n, count(DISTINCT ptype) AS types, count(DISTINCT floor(luma / 16)) AS levels, min(frame_idx) AS first FROM frames WHERE frame_idx >= 8 AND frame_idx < 32 GROUP BY clip_id",
}
