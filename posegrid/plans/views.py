"""The driver's tables seen as motion: poses, tracks, sample times and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posegrid.functions import quat as Q


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clip_frame(spark, sf) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select(F.col("label").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), "e")


def _each(df: DataFrame, joints: int, width: int, names: list[str]) -> DataFrame:
    at = df.select("clip", "frame", "e", F.explode(F.sequence(F.lit(0), F.lit(joints - 1))).alias("joint"))
    return at.select("clip", "frame", "joint", *[F.get("e", F.col("joint") * width + k).alias(n) for k, n in enumerate(names)])


def raw_quat(spark, sf) -> DataFrame:
    return _each(clip_frame(spark, sf), 16, 4, ["w0", "x0", "y0", "z0"])


def pose_quat(spark, sf) -> DataFrame:
    raw = tuple(F.col(c) for c in ("w0", "x0", "y0", "z0"))
    rows = raw_quat(spark, sf).where(Q.length(raw) > Q.SHORTEST)
    return rows.select("clip", "frame", "joint", *Q.named(tuple(c / Q.length(raw) for c in raw)))


def quat_pair(spark, sf) -> DataFrame:
    """Each pose's joint with the same joint a frame later; one window instead of a self join."""
    after = Window.partitionBy("clip", "joint").orderBy("frame")
    rows = pose_quat(spark, sf)
    rows = rows.withColumns({f"b{c}": F.lead(f"q{c}").over(after) for c in "wxyz"} | {"then": F.lead("frame").over(after)})
    return rows.where("then = frame + 1").select("clip", "frame", "joint", *[F.col(f"q{c}").alias(f"a{c}") for c in "wxyz"], *[f"b{c}" for c in "wxyz"])


def pose_position(spark, sf) -> DataFrame:
    return _each(clip_frame(spark, sf), 21, 3, ["px", "py", "pz"])


def pred_truth(spark, sf, root: int | None = None) -> DataFrame:
    """Predictions joined to truths as whole frames, so that the shuffle moves a row a frame.

    With ``root`` predictions are moved so that this joint is where the truth's is; it stands in the same row.
    """
    frames = clip_frame(spark, sf)
    truth = frames.select((F.pmod(F.col("clip") + 9, F.lit(10))).cast("int").alias("clip"), "frame", F.col("e").alias("t"))
    both = frames.join(truth, ["clip", "frame"])
    at = both.select("clip", "frame", "e", "t", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("joint"))
    parts = [F.get(a, F.col("joint") * 3 + k).alias(p + n) for a, p in (("e", "p"), ("t", "t")) for k, n in enumerate("xyz")]
    if root is not None:
        off = [F.get("t", F.lit(root * 3 + k)) - F.get("e", F.lit(root * 3 + k)) for k in range(3)]
        parts += [(F.get("e", F.col("joint") * 3 + k) + off[k]).alias("l" + n) for k, n in enumerate("xyz")]
    return at.select("clip", "frame", "joint", *parts)


def foot_track(spark, sf) -> DataFrame:
    """(clip, frame, foot, x, y, z): two joints of each pose taken as feet."""
    feet = F.array(*[F.struct(F.lit(j).alias("foot"), *[F.get("e", F.lit(3 * j + k)).alias(n) for k, n in enumerate("xyz")]) for j in (3, 7)])
    return clip_frame(spark, sf).select("clip", "frame", F.inline(feet))


def scalar_track(spark, sf) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rows.select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), F.col("value").alias("v"))


def track_size(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").cast("int").alias("n"))


def sparse_keys(spark, sf) -> DataFrame:
    n = F.max("frame").over(Window.partitionBy("clip"))
    return scalar_track(spark, sf).withColumn("last", n).where("frame % 7 = 0 OR frame = last").drop("last")


def sample_times(spark, sf) -> DataFrame:
    users = table(spark, sf, "events").agg((F.max("user_id") + 1).alias("users"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(F.broadcast(users))  # one row
    return rows.select(
        F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % F.col("users")).alias("clip"), ((F.col("o_orderkey") % 1000) * F.lit(0.1) - F.lit(10.0)).alias("t")
    )


def eval_sample(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    character, motion = F.col("o_orderkey") % 3 != 0, F.col("c_acctbal") > 100
    return rows.select(
        F.col("o_orderkey").alias("sample"), split(character, motion).alias("split"), character.alias("character_seen"), motion.alias("motion_seen"),
        F.col("o_totalprice").alias("mse"), F.when(F.col("o_orderkey") % 5 < 3, F.col("c_acctbal")).alias("geometry"),
        "o_custkey", "o_orderkey", "c_nationkey", "c_mktsegment",
    )


def split(character_seen, motion_seen):
    """The group of a sample."""
    word = lambda c: F.when(c, "seen").otherwise("unseen")
    return F.concat(word(character_seen), F.lit("_character_"), word(motion_seen), F.lit("_motion"))


def pair_score(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    return rows.select(
        (F.col("l_suppkey") % 4).cast("int").alias("source"), (F.col("l_partkey") % 4).cast("int").alias("target"), (F.col("l_orderkey") % 50).alias("clip"), F.col("l_quantity").alias("score")
    )
