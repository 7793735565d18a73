"""Where queries register, and the SQL of the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def micro(value: Column, name: str, scale: float = 1e6) -> Column:
    """A double as a whole number of millionths: engines may differ in a double's last bit."""
    return F.rint(value * scale).cast("long").alias(name)


def m(sql: str, name: str, scale: str = "1e6") -> str:
    """``micro`` in the oracle's SQL."""
    return f"CAST(round_even(({sql}) * {scale}, 0) AS BIGINT) AS {name}"


#: A skeleton of 16 joints: name, parent, offset.
TOY = [
    ("Hips", -1, (0.0, 9.0, 0.0)), ("Spine", 0, (0.0, 1.0, 0.0)), ("Spine1", 1, (0.0, 1.5, 0.0)), ("Neck", 2, (0.0, 1.5, 0.5)), ("Head", 3, (0.0, 1.0, 0.0)),
    ("LeftArm", 2, (1.5, 1.0, 0.0)), ("LeftForeArm", 5, (2.5, 0.0, 0.0)), ("LeftHand", 6, (2.0, 0.0, 0.0)),
    ("RightArm", 2, (-1.5, 1.0, 0.0)), ("RightForeArm", 8, (-2.5, 0.0, 0.0)), ("RightHand", 9, (-2.0, 0.0, 0.0)),
    ("LeftUpLeg", 0, (1.0, -0.5, 0.0)), ("LeftLeg", 11, (0.0, -4.0, 0.0)), ("LeftFoot", 12, (0.0, -4.0, 0.5)),
    ("RightUpLeg", 0, (-1.0, -0.5, 0.0)), ("RightLeg", 14, (0.0, -4.0, 0.0)),
]
#: The same bones with an engine's names, scaled, with a root and a third spine joint more.
ENGINE = [
    ("root", -1, (0.0, 0.0, 0.0)), ("pelvis", 0, (0.0, 10.8, 0.0)), ("spine_01", 1, (0.0, 1.2, 0.0)), ("spine_02", 2, (0.0, 0.9, 0.0)), ("spine_03", 3, (0.0, 0.9, 0.0)),
    ("neck_01", 4, (0.0, 1.8, 0.6)), ("head", 5, (0.0, 1.2, 0.0)), ("upperarm_l", 4, (1.8, 1.2, 0.0)), ("lowerarm_l", 7, (3.0, 0.0, 0.0)), ("hand_l", 8, (2.4, 0.0, 0.0)),
    ("upperarm_r", 4, (-1.8, 1.2, 0.0)), ("lowerarm_r", 10, (-3.0, 0.0, 0.0)), ("hand_r", 11, (-2.4, 0.0, 0.0)),
    ("thigh_l", 1, (1.2, -0.6, 0.0)), ("calf_l", 13, (0.0, -4.8, 0.0)), ("foot_l", 14, (0.0, -4.8, 0.6)), ("thigh_r", 1, (-1.2, -0.6, 0.0)), ("calf_r", 16, (0.0, -4.8, 0.0)),
]


def skeleton_sql(joints) -> str:
    rows = ", ".join(f"({i}, '{n}', {p}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (n, p, (x, y, z)) in enumerate(joints))
    return f"SELECT * FROM (VALUES {rows}) v(joint, name, parent, ox, oy, oz)"


#: A chain without names that mean anything; its height is that of its end sites.
BARE = [("b0", -1, (0.0, 1.0, 0.0)), ("b1", 0, (0.0, 2.0, 0.0)), ("b2", 1, (0.5, 0.25, 0.0)), ("b3", 0, (0.0, -0.5, 0.0))]
BARE_ENDS = {2: (0.0, 1.5, 0.0), 3: (0.0, -0.75, 0.25)}


def skeleton(spark: SparkSession, joints) -> DataFrame:
    rows = [(i, n, p, *map(float, o)) for i, (n, p, o) in enumerate(joints)]
    return spark.createDataFrame(rows, "joint int, name string, parent int, ox double, oy double, oz double")


#: The views, in the oracle's SQL, in the order in which they build on each other.
VIEWS = {
    "clip_frame": "SELECT label AS clip, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame, embedding AS e FROM embeddings",
    "raw_quat": "SELECT clip, frame, CAST(j AS INTEGER) AS joint, e[4*j+1]::DOUBLE AS w0, e[4*j+2]::DOUBLE AS x0, e[4*j+3]::DOUBLE AS y0, e[4*j+4]::DOUBLE AS z0 FROM clip_frame, range(0, 16) t(j)",
    "pose_quat": "SELECT clip, frame, joint, w0/n AS qw, x0/n AS qx, y0/n AS qy, z0/n AS qz FROM (SELECT *, sqrt(w0*w0+x0*x0+y0*y0+z0*z0) AS n FROM raw_quat) WHERE n > 1e-12",
    "quat_pair": "SELECT clip, frame, joint, aw, ax, ay, az, bw, bx, \"by\", bz FROM (SELECT clip, frame, joint, qw AS aw, qx AS ax, qy AS ay, qz AS az, lead(qw) OVER w AS bw, lead(qx) OVER w AS bx, lead(qy) OVER w AS \"by\", lead(qz) OVER w AS bz, lead(frame) OVER w AS later FROM pose_quat WINDOW w AS (PARTITION BY clip, joint ORDER BY frame)) WHERE later = frame + 1",
    "pose_position": "SELECT clip, frame, CAST(j AS INTEGER) AS joint, e[3*j+1]::DOUBLE AS px, e[3*j+2]::DOUBLE AS py, e[3*j+3]::DOUBLE AS pz FROM clip_frame, range(0, 21) t(j)",
    "pred_truth": "SELECT a.clip, a.frame, a.joint, a.px, a.py, a.pz, b.px AS tx, b.py AS ty, b.pz AS tz FROM pose_position a JOIN pose_position b ON b.clip = (a.clip + 1) % 10 AND a.frame = b.frame AND a.joint = b.joint",
    "scalar_track": "SELECT user_id AS clip, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value AS v FROM events",
    "track_size": "SELECT clip, CAST(max(frame) + 1 AS INTEGER) AS n FROM scalar_track GROUP BY clip",
    "sparse_keys": "SELECT s.clip, s.frame, s.v FROM scalar_track s JOIN track_size t ON s.clip = t.clip WHERE s.frame % 7 = 0 OR s.frame = t.n - 1",
    "sample_times": "SELECT o_orderkey AS sample, (o_custkey % ((SELECT max(user_id) FROM events) + 1)) AS clip, (o_orderkey % 1000) * 0.1::DOUBLE - 10.0::DOUBLE AS t FROM orders",
    "eval_sample": "SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 3 = 0 THEN 'unseen' ELSE 'seen' END || '_character_' || CASE WHEN c_acctbal > 100 THEN 'seen' ELSE 'unseen' END || '_motion' AS split, o_orderkey % 3 <> 0 AS character_seen, c_acctbal > 100 AS motion_seen, o_totalprice AS mse, CASE WHEN o_orderkey % 5 < 3 THEN c_acctbal END AS geometry, o_custkey, o_orderkey, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "pair_score": "SELECT CAST(l_suppkey % 4 AS INTEGER) AS source, CAST(l_partkey % 4 AS INTEGER) AS target, l_orderkey % 50 AS clip, l_quantity AS score FROM lineitem",
    "foot_track": "SELECT clip, frame, joint AS foot, px AS x, py AS y, pz AS z FROM pose_position WHERE joint IN (3, 7)",
    "foot_contact": "SELECT clip, frame, foot, x, y, z, y <= min(y) OVER (PARTITION BY clip, foot) + 0.03 * 8 AND coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(z) OVER w - z) * (lead(z) OVER w - z)), 0) / 0.5 <= 0.15 * 8 AS active FROM foot_track WINDOW w AS (PARTITION BY clip, foot ORDER BY frame)",
    "toy": skeleton_sql(TOY),
    "engine": skeleton_sql(ENGINE),
}
_NEEDS = {v: [w for w in VIEWS if w != v and f" {w}" in sql] for v, sql in VIEWS.items()}


def using(*names: str, recursive: bool = False) -> str:
    """The WITH clause of the named views and of those they build on; more may follow after a comma."""
    need: set[str] = set()

    def add(n):
        if n not in need:
            need.add(n)
            for d in _NEEDS[n]:
                add(d)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
