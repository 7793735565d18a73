"""Operators along a track (WIN), filters on them and the metric aggregates (AGG, FLT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from posegrid.plans import views as V
from posegrid.plans.registry import m, micro, query, using



def track():
    return Window.partitionBy("clip").orderBy("frame")


def so_far():
    return track().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_here():
    return track().rowsBetween(1, Window.unboundedFollowing)


ST, SK = using("scalar_track"), using("scalar_track", "sparse_keys")
PI = 3.141592653589793


def unwrap(angle, order):
    """The running correction that keeps jumps between frames within half a turn."""
    jump = angle - F.lag(angle).over(order)
    turn = F.pmod(jump + PI, F.lit(2 * PI)) - PI
    turn = F.when((turn == -PI) & (jump > 0), F.lit(PI)).otherwise(turn)
    return F.when(F.abs(jump) < PI, 0.0).otherwise(turn - jump)


_ANG = ",\na AS (SELECT clip, frame, v / 40 AS a, v / 40 - lag(v / 40) OVER (PARTITION BY clip ORDER BY frame) AS j FROM scalar_track),\nc AS (SELECT *, CASE WHEN j IS NULL OR abs(j) < pi() THEN 0 ELSE (j + pi()) - 2*pi()*floor((j + pi()) / (2*pi())) - pi() - j END AS c FROM a)\n"


@query("WIN1", ST + _ANG + "SELECT clip, frame, " + m("a + sum(c) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)", "angle") + " FROM c")
def unwrapped(spark, sf):
    rows = V.scalar_track(spark, sf).select("clip", "frame", (F.col("v") / 40).alias("a"))
    rows = rows.withColumn("c", F.coalesce(unwrap(F.col("a"), track()), F.lit(0.0)))
    return rows.select("clip", "frame", micro(F.col("a") + F.sum("c").over(so_far()), "angle"))


SPEED = "coalesce(abs(v - lag(v) OVER w), abs(lead(v) OVER w - v), 0) / 0.5"


def speed(value, order, frame_time: float):
    """Change a second; the first frame has the second's, a single frame 0."""
    step = F.coalesce(F.abs(value - F.lag(value).over(order)), F.abs(F.lead(value).over(order) - value), F.lit(0.0))
    return step / frame_time


def foot():
    return Window.partitionBy("clip", "foot").orderBy("frame")


def horizontal_speed(order, frame_time: float):
    """Way a second in the plane across ``y``; the first frame has the second's, a single frame 0."""
    way = lambda step: F.sqrt(sum((step(c) * step(c) for c in "z"), step("x") * step("x")))
    back, ahead = way(lambda c: F.col(c) - F.lag(c).over(order)), way(lambda c: F.lead(c).over(order) - F.col(c))
    return F.coalesce(back, ahead, F.lit(0.0)) / frame_time


_WAY = "coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(z) OVER w - z) * (lead(z) OVER w - z)), 0) / 0.5"


@query("WIN2", using("foot_track") + f"\nSELECT clip, frame, foot, {m(_WAY, 'speed')} FROM foot_track WINDOW w AS (PARTITION BY clip, foot ORDER BY frame)")
def speeds(spark, sf):
    return V.foot_track(spark, sf).select("clip", "frame", "foot", micro(horizontal_speed(foot(), 0.5), "speed"))


@query("PRJ28", ST + "\nSELECT clip, frame, " + m("v - coalesce(lag(v) OVER (PARTITION BY clip ORDER BY frame), v)", "step") + " FROM scalar_track")
def differences(spark, sf):
    return V.scalar_track(spark, sf).select("clip", "frame", micro(F.col("v") - F.coalesce(F.lag("v").over(track()), F.col("v")), "step"))


@query("WIN3", ST + "\nSELECT clip, frame, " + m("v - min(v) OVER (PARTITION BY clip)", "above") + " FROM scalar_track")
def above_floor(spark, sf):
    return V.scalar_track(spark, sf).select("clip", "frame", micro(F.col("v") - F.min("v").over(Window.partitionBy("clip")), "above"))


def in_contact(height, speed_, floor, size: float):
    """Low and slow, as shares of the skeleton's height."""
    return (height <= floor + 0.03 * size) & (speed_ <= 0.15 * size)


_CONTACT = f"contact AS (SELECT clip, frame, v, v <= min(v) OVER (PARTITION BY clip) + 0.03 * 2000 AND {SPEED} <= 0.15 * 2000 AS active FROM scalar_track WINDOW w AS (PARTITION BY clip ORDER BY frame))"


def contact(spark, sf):
    floor = F.min("v").over(Window.partitionBy("clip"))
    return V.scalar_track(spark, sf).select("clip", "frame", "v", in_contact(F.col("v"), speed(F.col("v"), track(), 0.5), floor, 2000.0).alias("active"))


def foot_contact(spark, sf):
    """(clip, frame, foot, x, y, z, active): a foot near its floor that hardly moves in the plane."""
    floor = F.min("y").over(Window.partitionBy("clip", "foot"))
    return V.foot_track(spark, sf).withColumn("active", in_contact(F.col("y"), horizontal_speed(foot(), 0.5), floor, 8.0))


@query("FLT6", using("foot_contact") + "\nSELECT clip, frame, foot, active FROM foot_contact")
def contact_mask(spark, sf):
    return foot_contact(spark, sf).select("clip", "frame", "foot", "active")


@query("WIN4", ST + f",\n{_CONTACT},\ne AS (SELECT *, CASE WHEN active AND NOT coalesce(lag(active) OVER (PARTITION BY clip ORDER BY frame), false) THEN 1 ELSE 0 END AS edge FROM contact),\ni AS (SELECT *, sum(edge) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM e)\nSELECT clip, CAST(island AS BIGINT) AS island, min(frame) AS first, max(frame) AS last, " + m("min_by(v, frame)", "anchor") + " FROM i WHERE active GROUP BY clip, island")
def islands(spark, sf):
    edge = (F.col("active") & ~F.coalesce(F.lag("active").over(track()), F.lit(False))).cast("int")
    rows = contact(spark, sf).withColumn("edge", edge).withColumn("island", F.sum("edge").over(so_far())).where("active")
    return rows.groupBy("clip", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), micro(F.min_by("v", "frame"), "anchor"))


@query("WIN5", SK + "\nSELECT clip, frame, frame - coalesce(lag(frame) OVER (PARTITION BY clip ORDER BY frame), 0) AS delta FROM sparse_keys")
def deltas(spark, sf):
    return V.sparse_keys(spark, sf).select("clip", "frame", (F.col("frame") - F.lag("frame", 1, 0).over(track())).alias("delta"))


def segments(frames, keys):
    """Each frame with the last key at or before it and the first key after it; the last frame ends the last segment."""
    marked = frames.join(keys.select("clip", "frame", F.col("v").alias("kv")), ["clip", "frame"], "left")
    k = F.when(F.col("kv").isNotNull(), F.struct("frame", "kv"))
    out = marked.withColumn("a", F.last(k, ignorenulls=True).over(so_far())).withColumn("b", F.first(k, ignorenulls=True).over(from_here()))
    return out.withColumn("b", F.coalesce("b", "a"))


_SEG = ",\nk AS (SELECT s.clip, s.frame, CASE WHEN p.frame IS NOT NULL THEN {'f': s.frame, 'v': p.v} END AS k FROM scalar_track s LEFT JOIN sparse_keys p ON s.clip = p.clip AND s.frame = p.frame),\ng AS (SELECT clip, frame, last_value(k IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM k)\n"
_LERP = "CASE WHEN b IS NULL THEN a.v ELSE a.v + (frame - a.f)::DOUBLE / (b.f - a.f) * (b.v - a.v) END"


def interpolated(spark, sf):
    rows = segments(V.scalar_track(spark, sf), V.sparse_keys(spark, sf))
    share = F.when(F.col("b.frame") > F.col("a.frame"), (F.col("frame") - F.col("a.frame")).cast("double") / (F.col("b.frame") - F.col("a.frame"))).otherwise(0.0)
    return rows.withColumn("value", F.col("a.kv") + share * (F.col("b.kv") - F.col("a.kv")))


@query("WIN6", SK + _SEG + f"SELECT clip, frame, {m(_LERP, 'value')} FROM g")
def filled(spark, sf):
    return interpolated(spark, sf).select("clip", "frame", micro(F.col("value"), "value"))


@query("JON6", SK + "\nSELECT s.clip, s.frame, k.frame AS key_frame, " + m("k.v", "key_value") + " FROM scalar_track s ASOF JOIN sparse_keys k ON s.clip = k.clip AND s.frame >= k.frame")
def asof_key(spark, sf):
    rows = segments(V.scalar_track(spark, sf), V.sparse_keys(spark, sf))
    return rows.select("clip", "frame", F.col("a.frame").alias("key_frame"), micro(F.col("a.kv"), "key_value"))


@query("COD4", SK + _SEG + "SELECT clip, " + m(f"max(abs(({_LERP}) - s.v))", "worst") + ", count(*) AS n FROM g JOIN scalar_track s USING (clip, frame) GROUP BY clip")
def decoded_tracks(spark, sf):
    rows = interpolated(spark, sf).select("clip", F.abs(F.col("value") - F.col("v")).alias("e"))
    return rows.groupBy("clip").agg(micro(F.max("e"), "worst"), F.count("*").alias("n"))


@query("WIN8", ST + "\nSELECT clip, CAST(frame // 10 AS INTEGER) AS batch, count(*) AS n, " + m("avg(v)", "mean") + " FROM scalar_track GROUP BY ALL")
def batches(spark, sf):
    return V.scalar_track(spark, sf).groupBy("clip", F.expr("frame div 10").cast("int").alias("batch")).agg(F.count("*").alias("n"), micro(F.avg("v"), "mean"))


# --- aggregates -------------------------------------------------------------------------------

PT = using("pred_truth")
SQ = "((px-tx)*(px-tx) + (py-ty)*(py-ty) + (pz-tz)*(pz-tz))"
_LOCAL = ",\nr AS (SELECT *, max(px) FILTER (joint = 0) OVER f AS rx, max(py) FILTER (joint = 0) OVER f AS ry, max(pz) FILTER (joint = 0) OVER f AS rz, max(tx) FILTER (joint = 0) OVER f AS sx, max(ty) FILTER (joint = 0) OVER f AS sy, max(tz) FILTER (joint = 0) OVER f AS sz FROM pred_truth WINDOW f AS (PARTITION BY clip, frame))\n"
_LSQ = "((px-rx+sx-tx)*(px-rx+sx-tx) + (py-ry+sy-ty)*(py-ry+sy-ty) + (pz-rz+sz-tz)*(pz-rz+sz-tz))"


def square(a: str, b: str):
    return sum(((F.col(a + c) - F.col(b + c)) * (F.col(a + c) - F.col(b + c)) for c in "yz"), (F.col(a + "x") - F.col(b + "x")) * (F.col(a + "x") - F.col(b + "x")))


def mse(height: float, moved: str = "p"):
    """Mean squared coordinate difference over the squared height; ``moved`` "l": of root-aligned predictions."""
    return F.avg(square(moved, "t") / 3) / (height * height)


def mean_distance(height: float):
    return F.avg(F.sqrt(square("p", "t"))) / height * 1000


def root_aligned(rows, keys=("clip", "frame"), root: int = 0):
    """For rows of joints: predictions moved so that their root is where the truth's is; one window. Where a frame is a row, ``views.pred_truth`` does without."""
    frame = Window.partitionBy(*keys)
    at = lambda c: F.max(F.when(F.col("joint") == root, F.col(c))).over(frame)
    moved = rows.withColumns({"off" + c: at("t" + c) - at("p" + c) for c in "xyz"})
    return moved.withColumns({"p" + c: F.col("p" + c) + F.col("off" + c) for c in "xyz"}).drop(*["off" + c for c in "xyz"])


@query("AGG1", PT + "\nSELECT clip, " + m(f"avg({SQ}/3)/(1.8*1.8)", "mse") + " FROM pred_truth GROUP BY clip")
def agg1(spark, sf):
    return V.pred_truth(spark, sf).groupBy("clip").agg(micro(mse(1.8), "mse"))


@query("AGG2", PT + _LOCAL + "SELECT clip, " + m(f"avg({_LSQ}/3)/(1.8*1.8)", "local_mse") + " FROM r GROUP BY clip")
def agg2(spark, sf):
    return V.pred_truth(spark, sf, root=0).groupBy("clip").agg(micro(mse(1.8, "l"), "local_mse"))


@query("AGG3", PT + "\nSELECT clip, " + m(f"avg(sqrt({SQ}))/1.8*1000", "distance", "1e3") + " FROM pred_truth GROUP BY clip")
def agg3(spark, sf):
    return V.pred_truth(spark, sf).groupBy("clip").agg(micro(mean_distance(1.8), "distance", 1e3))


@query("AGG4", PT + "\nSELECT clip, " + m(f"avg({SQ}/3)/(1.8*1.8)*1000", "official", "1e3") + " FROM pred_truth GROUP BY clip")
def agg4(spark, sf):
    return V.pred_truth(spark, sf).groupBy("clip").agg(micro(mse(1.8) * 1000, "official", 1e3))


_PEN = "pen AS (SELECT CAST(l_orderkey % 97 AS INTEGER) AS clip, l_discount AS p, l_tax + 0.1 AS t FROM lineitem)"


def penetration(spark, sf):
    """(clip, p, t): penetrated and all vertices of frames, as counts must be; others are an error."""
    rows = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 97).cast("int").alias("clip"), F.col("l_discount").alias("p"), (F.col("l_tax") + F.lit(0.1)).alias("t"))
    sound = F.coalesce((F.col("t") > 0) & (F.col("p") >= 0) & (F.col("p") <= F.col("t")), F.lit(False))
    return rows.withColumn("p", F.when(sound, F.col("p")).otherwise(F.raise_error(F.lit("penetrated vertices must lie between 0 and all vertices")).cast("double")))


def percent():
    return F.avg(F.col("p") / F.col("t")) * 100


@query("AGG5", f"WITH {_PEN}\nSELECT clip, " + m("avg(p/t)*100", "percent", "1e4") + " FROM pen GROUP BY clip")
def agg5(spark, sf):
    """Mean of the frames' ratios, not the ratio of sums."""
    return penetration(spark, sf).groupBy("clip").agg(micro(percent(), "percent", 1e4))


_CON = "con AS (SELECT clip, avg(abs(x)) FILTER (WHERE isfinite(x)) AS cm FROM (SELECT clip, unnest(e)::DOUBLE AS x FROM clip_frame) GROUP BY clip)"


@query("AGG6", using("clip_frame") + f",\n{_CON}\nSELECT clip, {m('cm', 'cm')} FROM con")
def agg6(spark, sf):
    return contact_distance(spark, sf).select("clip", micro(F.col("cm"), "cm"))


def contact_distance(spark, sf):
    """Mean of all finite distances; each vector is reduced where it lies, without a row for each number."""
    x = F.filter("e", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    parts = V.clip_frame(spark, sf).select("clip", F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)).alias("s"), F.size(x).alias("n"))
    return parts.groupBy("clip").agg((F.sum("s") / F.sum("n")).alias("cm"))


#: The nine metrics of a motion; the last two are null where a clip has no counts or distances.
METRICS = ["global_mse_raw", "global_mse_x1e3", "local_mse_raw", "local_mse_x1e3", "san_paper_position_error_x1e3", "san_official_code_mse_raw", "san_official_code_mse_x1e3", "penetration_percent", "contact_distance_cm"]
_M = f"mo AS (SELECT clip, avg({SQ}/3)/(1.8*1.8) AS g, avg({_LSQ}/3)/(1.8*1.8) AS l, avg(sqrt({SQ}))/1.8*1000 AS d FROM r GROUP BY clip)"
NINE = PT + _LOCAL.rstrip() + f",\n{_M},\n{_PEN},\npe AS (SELECT clip, avg(p/t)*100 AS pct FROM pen WHERE clip % 2 = 0 GROUP BY clip),\n{_CON},\nnine AS (SELECT mo.clip, g AS global_mse_raw, g*1000 AS global_mse_x1e3, l AS local_mse_raw, l*1000 AS local_mse_x1e3, d AS san_paper_position_error_x1e3, g AS san_official_code_mse_raw, g*1000 AS san_official_code_mse_x1e3, pct AS penetration_percent, CASE WHEN mo.clip % 3 <> 0 THEN cm END AS contact_distance_cm FROM mo LEFT JOIN pe ON pe.clip = mo.clip LEFT JOIN con ON con.clip = mo.clip)\n"


def nine_metrics(spark, sf):
    """(clip, METRICS): one aggregation of the joined poses; counts exist for even clips, distances for two of three."""
    moved = V.pred_truth(spark, sf, root=0).withColumn("g", square("p", "t"))
    rows = moved.groupBy("clip").agg(
        (F.avg(F.col("g") / 3) / (1.8 * 1.8)).alias("global_mse_raw"), mse(1.8, "l").alias("local_mse_raw"), (F.avg(F.sqrt("g")) / 1.8 * 1000).alias("san_paper_position_error_x1e3")
    )
    counts = penetration(spark, sf).where("clip % 2 = 0").groupBy("clip").agg(percent().alias("penetration_percent"))
    distances = contact_distance(spark, sf).where("clip % 3 <> 0").withColumnRenamed("cm", "contact_distance_cm")
    rows = rows.join(counts, "clip", "left").join(distances, "clip", "left")
    again = {f"{kind}_x1e3": F.col("global_mse_raw") * 1000 for kind in ("global_mse", "san_official_code_mse")} | {"local_mse_x1e3": F.col("local_mse_raw") * 1000, "san_official_code_mse_raw": F.col("global_mse_raw")}
    return rows.withColumns(again).select("clip", *METRICS)


@query("AGG7", NINE + "SELECT clip, " + ", ".join(m(c, c, "1e4") for c in METRICS) + " FROM nine")
def agg7(spark, sf):
    """All metrics of a clip."""
    return nine_metrics(spark, sf).select("clip", *[micro(F.col(c), c, 1e4) for c in METRICS])


SPLITS = [f"{c}_character_{s}_motion" for c in ("seen", "unseen") for s in ("seen", "unseen")]
_AGG8 = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in SPLITS) + ", ('overall'), ('never')) v(split)), g AS (SELECT coalesce(split, 'overall') AS split, count(*) AS n, avg(mse) AS mse, avg(geometry) AS geometry FROM eval_sample GROUP BY GROUPING SETS ((split), ()))"


def split_report(rows, groups: list[str], metrics: tuple[str, ...] = ("mse", "geometry")):
    """Null-skipping means of every group and of all; groups without rows have a count of 0."""
    spark = rows.sparkSession
    means = [F.count("*").alias("n"), *[F.avg(c).alias(c) for c in metrics]]
    found = rows.groupingSets([["split"], []], "split").agg(*means).withColumn("split", F.coalesce("split", F.lit("overall")))
    every = spark.createDataFrame([(s,) for s in [*groups, "overall"]], "split string")
    return every.join(F.broadcast(found), "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # found has a row a group


def _report(df):
    return df.select("split", "n", micro(F.col("mse"), "mse", 100), micro(F.col("geometry"), "geometry", 100))


_AGG8_OUT = f"SELECT s.split, coalesce(n, 0) AS n, {m('mse', 'mse', '100')}, {m('geometry', 'geometry', '100')} FROM s LEFT JOIN g ON s.split = g.split"


@query("AGG8", using("eval_sample") + f",\n{_AGG8}\n{_AGG8_OUT}")
def agg8(spark, sf):
    return _report(split_report(V.eval_sample(spark, sf), [*SPLITS, "never"]))


@query("SNK5", using("eval_sample") + f",\n{_AGG8}\nSELECT count(*) AS groups, sum(coalesce(n, 0))::BIGINT AS n FROM s LEFT JOIN g ON s.split = g.split")
def snk5(spark, sf):
    """The report as one JSON document, read back."""
    rows = split_report(V.eval_sample(spark, sf), [*SPLITS, "never"])
    text = rows.agg(F.to_json(F.struct(F.collect_list(F.struct("split", "n", "mse", "geometry")).alias("groups"))).alias("j"))  # a few groups
    back = text.select(F.from_json("j", "groups array<struct<split: string, n: bigint>>")["groups"].alias("g"))
    return back.select(F.size("g").cast("long").alias("groups"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))


@query("AGG10", using("pair_score") + "\nSELECT count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, count(DISTINCT (source, target)) AS pairs, count(DISTINCT source) * count(DISTINCT target) = count(DISTINCT (source, target)) AS complete FROM pair_score")
def agg10(spark, sf):
    rows = V.pair_score(spark, sf).select("source", "target").distinct()
    n, s, t = F.count("*"), F.count_distinct("source"), F.count_distinct("target")
    return rows.agg(s.alias("sources"), t.alias("targets"), n.alias("pairs"), (s * t == n).alias("complete"))


@query("AGG11", using("track_size", "sparse_keys") + "\nSELECT t.clip, t.n * 6 * 4 AS raw, k.n AS keys, " + ", ".join([m("t.n * 24.0::DOUBLE / (k.n * 3)", "ratio"), m("k.n * 3 * 8.0::DOUBLE / t.n", "bits")]) + " FROM track_size t JOIN (SELECT clip, count(*) AS n FROM sparse_keys GROUP BY clip) k USING (clip)")
def agg11(spark, sf):
    keys = V.sparse_keys(spark, sf).groupBy("clip").agg(F.count("*").alias("keys"))
    rows = V.track_size(spark, sf).join(keys, "clip")
    return rows.select("clip", (F.col("n") * 24).alias("raw"), "keys", micro(F.col("n") * F.lit(24.0) / (F.col("keys") * 3), "ratio"), micro(F.col("keys") * 3 * F.lit(8.0) / F.col("n"), "bits"))


@query("AGG12", "WITH g AS (SELECT l_returnflag AS character, sum(l_extendedprice) AS raw, sum(l_quantity) AS enc, max(l_discount) AS worst FROM lineitem GROUP BY ROLLUP(l_returnflag))\nSELECT coalesce(character, 'overall') AS character, " + ", ".join([m("raw/enc", "ratio", "1e4"), m("worst", "worst"), m("min(raw/enc) FILTER (WHERE character IS NOT NULL) OVER ()", "least", "1e4")]) + " FROM g")
def agg12(spark, sf):
    """Ratios of sums for each character and in all, and the least of the characters."""
    rows = V.table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.sum("l_extendedprice").alias("raw"), F.sum("l_quantity").alias("enc"), F.max("l_discount").alias("worst"))
    ratio = F.col("raw") / F.col("enc")
    least = F.min(F.when(F.col("l_returnflag").isNotNull(), ratio)).over(Window.partitionBy())  # a row a character
    return rows.select(F.coalesce("l_returnflag", F.lit("overall")).alias("character"), micro(ratio, "ratio", 1e4), micro(F.col("worst"), "worst"), micro(least, "least", 1e4))


_CLIPM = "c AS (SELECT source, target, clip, avg(score) AS s FROM pair_score GROUP BY ALL), p AS (SELECT source, target, avg(s) AS s FROM c GROUP BY ALL)"


def pair_means(rows):
    """Clips weigh the same in a pair."""
    return rows.groupBy("source", "target", "clip").agg(F.avg("score").alias("s")).groupBy("source", "target").agg(F.avg("s").alias("s"))


@query("AGG13", using("pair_score") + f",\n{_CLIPM}\nSELECT {m('avg(s)', 'all_pairs')}, {m('avg(s) FILTER (WHERE source <> target)', 'cross_pairs')}, count(*) AS n FROM p")
def agg13(spark, sf):
    p = pair_means(V.pair_score(spark, sf))
    return p.agg(micro(F.avg("s"), "all_pairs"), micro(F.avg(F.when(F.col("source") != F.col("target"), F.col("s"))), "cross_pairs"), F.count("*").alias("n"))


@query("FLT8", using("pair_score") + f",\n{_CLIPM}\nSELECT source, target, {m('s', 'score')} FROM p WHERE source <> target")
def flt8(spark, sf):
    return pair_means(V.pair_score(spark, sf).where("source <> target")).select("source", "target", micro(F.col("s"), "score"))


@query("AGG14", ST + "\nSELECT clip, " + m("quantile_cont(v, 0.5)", "p50") + ", " + m("quantile_cont(v, 0.95)", "p95") + " FROM scalar_track GROUP BY clip")
def agg14(spark, sf):
    rows = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip"))
    return rows.agg(micro(F.percentile("value", 0.5), "p50"), micro(F.percentile("value", 0.95), "p95"))


@query("AGG15", ST + "\nSELECT clip, " + m("median(v)", "median") + " FROM scalar_track GROUP BY clip")
def agg15(spark, sf):
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(micro(F.median("value"), "median"))


@query("AGG16", using("raw_quat") + "\nSELECT clip, " + m("max(abs(sqrt(w0*w0+x0*x0+y0*y0+z0*z0) - 1))", "worst") + " FROM raw_quat GROUP BY clip")
def agg16(spark, sf):
    from posegrid.functions import quat as Q

    n = Q.length(tuple(F.col(c + "0") for c in "wxyz"))
    return V.raw_quat(spark, sf).groupBy("clip").agg(micro(F.max(F.abs(n - 1)), "worst"))


@query("AGG17", using("track_size", "scalar_track") + "\nSELECT t.clip, " + m("t.n * (1/30.0::DOUBLE) / (e.s / 1000)", "factor", "1e4") + " FROM track_size t JOIN (SELECT clip, sum(v) AS s FROM scalar_track GROUP BY clip) e USING (clip)")
def agg17(spark, sf):
    rows = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return rows.select("clip", micro(F.col("n") * F.lit(1 / 30.0) / (F.col("s") / 1000), "factor", 1e4))


@query("AGG19", ST + "\nSELECT clip, " + ", ".join([m("min(v)", "lo"), m("max(v)", "hi"), m("max(v) - min(v)", "span")]) + " FROM scalar_track GROUP BY clip")
def agg19(spark, sf):
    lo, hi = F.min("value"), F.max("value")
    return V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(micro(lo, "lo"), micro(hi, "hi"), micro(hi - lo, "span"))


@query("AGG20", SK + "\nSELECT clip, count(*) AS keys FROM sparse_keys GROUP BY ROLLUP(clip)")
def agg20(spark, sf):
    return V.sparse_keys(spark, sf).rollup("clip").agg(F.count("*").alias("keys"))


@query("AGG25", ST + "\nSELECT clip, max_by(frame, row(round(v), -frame)) AS worst FROM scalar_track GROUP BY clip")
def agg25(spark, sf):
    """The frame of the largest value, the first of equal ones."""
    return V.scalar_track(spark, sf).groupBy("clip").agg(F.max_by("frame", F.struct(F.round("v"), -F.col("frame"))).alias("worst"))


@query("ORD3", ST + "\nSELECT clip, arg_max(frame, row(v, -frame)) AS top FROM scalar_track GROUP BY clip")
def ord3(spark, sf):
    return V.scalar_track(spark, sf).groupBy("clip").agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("top"))
