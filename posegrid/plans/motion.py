"""Joins (JON), hierarchies (REC), key reduction, retargeting (RET) and sampling (SMP)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from posegrid.functions import codes, names
from posegrid.functions import quat as Q
from posegrid.operators import hierarchy as H
from posegrid.operators import keys as K
from posegrid.operators import resample
from posegrid.operators import retarget as R
from posegrid.plans import views as V
from posegrid.plans.projections import ALIAS_SQL, S3, meaning_sql
from posegrid.plans.registry import BARE, BARE_ENDS, ENGINE, TOY, m, micro, query, skeleton, skeleton_sql, using
from posegrid.plans.windows import foot_contact

PARENTS = [p for _, p, _ in TOY]
OFFSETS = [o for _, _, o in TOY]


def poses(spark, sf):
    """(clip, frame, rotations): 16 unit quaternions a row."""
    part = lambda j, k: F.get("e", j * 4 + k)

    def unit(j):
        n = F.sqrt(sum((part(j, k) * part(j, k) for k in (1, 2, 3)), part(j, 0) * part(j, 0)))
        return F.array(*[part(j, k) / n for k in range(4)])

    return V.clip_frame(spark, sf).select("clip", "frame", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), unit)).alias("rotations"))


def moving_poses(spark, sf):
    """``poses`` with translations: the rest offsets, the root moving along."""
    rest = [F.lit(float(v)) for o in OFFSETS for v in o]
    rest[0] = rest[0] + F.col("frame") * F.lit(0.25)
    return poses(spark, sf).withColumn("translations", F.array(*rest))


def _rot(g, v):
    """SQL of a vector turned by a quaternion, from component names."""
    (w, x, y, z), (a, b, c) = g, v
    tx, ty, tz = f"(2*({y}*{c}-{z}*{b}))", f"(2*({z}*{a}-{x}*{c}))", f"(2*({x}*{b}-{y}*{a}))"
    return [f"({a}+{w}*{tx}+({y}*{tz}-{z}*{ty}))", f"({b}+{w}*{ty}+({z}*{tx}-{x}*{tz}))", f"({c}+{w}*{tz}+({x}*{ty}-{y}*{tx}))"]


def _mul(a, b):
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [f"({aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz})", f"({aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by})", f"({aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx})", f"({aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw})"]


G, LQ, O = ["f.gw", "f.gx", "f.gy", "f.gz"], ["p.qw", "p.qx", "p.qy", "p.qz"], ["t.ox", "t.oy", "t.oz"]
_g, _v = _mul(G, LQ), _rot(G, O)


def fk_sql(name: str, quats: str) -> str:
    """Global rotations and positions of the toy skeleton from a view of local rotations."""
    return f""",
{name} AS (
  SELECT p.clip, p.frame, p.joint, p.qw AS gw, p.qx AS gx, p.qy AS gy, p.qz AS gz, t.ox AS x, t.oy AS y, t.oz AS z FROM {quats} p JOIN toy t ON p.joint = t.joint WHERE t.parent = -1
  UNION ALL
  SELECT f.clip, f.frame, CAST(t.joint AS INTEGER), {_g[0]}, {_g[1]}, {_g[2]}, {_g[3]}, f.x+{_v[0]}, f.y+{_v[1]}, f.z+{_v[2]}
  FROM {name} f JOIN toy t ON t.parent = f.joint JOIN {quats} p ON p.clip = f.clip AND p.frame = f.frame AND p.joint = t.joint
)"""


FK = using("pose_quat", "toy", recursive=True) + fk_sql("fk", "pose_quat")


def kinematics(spark, sf):
    return H.forward_kinematics(poses(spark, sf), PARENTS, OFFSETS)


@query("REC1", FK + "\nSELECT clip, frame, joint, " + ", ".join(m(c, c, "1e5") for c in "xyz") + " FROM fk")
def rec1(spark, sf):
    return kinematics(spark, sf).select("clip", "frame", "joint", *[micro(F.col(c), c, 1e5) for c in "xyz"])


@query("REC4", FK + "\nSELECT clip, frame, joint, " + ", ".join(m(f"g{c}", f"g{c}", "1e5") for c in "wxyz") + " FROM fk")
def rec4(spark, sf):
    return kinematics(spark, sf).select("clip", "frame", "joint", *[micro(F.col(f"g{c}"), f"g{c}", 1e5) for c in "wxyz"])


@query("JON8", FK + "\nSELECT a.clip, a.joint, " + m("avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)))", "bone", "1e5") + " FROM fk a JOIN toy t ON a.joint = t.joint JOIN fk b ON b.joint = t.parent AND a.clip = b.clip AND a.frame = b.frame GROUP BY a.clip, a.joint")
def jon8(spark, sf):
    """Bones' lengths: a joint and its parent stand in one pose, so the join stays within the row."""
    frames = H.global_positions(poses(spark, sf), PARENTS, OFFSETS)
    at = lambda j, k: F.get("positions", j * 3 + k)
    bones = F.array(*[F.struct(F.lit(j).alias("joint"), F.sqrt(sum(((at(F.lit(j), k) - at(F.lit(p), k)) ** 2 for k in (1, 2)), (at(F.lit(j), 0) - at(F.lit(p), 0)) ** 2)).alias("d")) for j, p in enumerate(PARENTS) if p >= 0])
    return frames.select("clip", F.inline(bones)).groupBy("clip", "joint").agg(micro(F.avg("d"), "bone", 1e5))


UPSQL = ",\nup AS (SELECT joint, joint AS ancestor, parent AS next, 0 AS depth FROM toy UNION ALL SELECT u.joint, s.joint, s.parent, u.depth + 1 FROM up u JOIN toy s ON s.joint = u.next)"
REST = UPSQL + ",\nrest AS (SELECT u.joint, sum(ox) AS x, sum(oy) AS y, sum(oz) AS z, sum(CASE WHEN s.parent >= 0 THEN sqrt(ox*ox+oy*oy+oz*oz) ELSE 0 END) AS len FROM up u JOIN toy s ON s.joint = u.ancestor GROUP BY u.joint)"


@query("REC2", using("toy", recursive=True) + REST + "\nSELECT CAST(joint AS INTEGER) AS joint, " + ", ".join([*(m(c, c) for c in "xyz"), m("len", "length")]) + " FROM rest")
def rec2(spark, sf):
    return H.rest_positions(spark, skeleton(spark, TOY)).select("joint", *[micro(F.col(c), c) for c in ("x", "y", "z", "length")])


@query("REC3", using("toy", recursive=True) + UPSQL + "\nSELECT DISTINCT CAST(ancestor AS INTEGER) AS joint FROM up WHERE joint IN (7, 13)")
def rec3(spark, sf):
    """The joints that two selected ones need, themselves included; parents come before children."""
    up = H.ancestors(spark, skeleton(spark, TOY))
    return up.where("joint IN (7, 13)").select(F.col("ancestor").alias("joint")).distinct().orderBy("joint")


_BARE = "bare AS (SELECT v.*, e.ey FROM (" + skeleton_sql(BARE) + ") v LEFT JOIN (VALUES " + ", ".join(f"({j}, {e[1]}::DOUBLE)" for j, e in BARE_ENDS.items()) + ") e(j, ey) ON e.j = v.joint)"
_BUP = ",\nbup AS (SELECT joint, joint AS ancestor, parent AS next FROM bare UNION ALL SELECT u.joint, s.joint, s.parent FROM bup u JOIN bare s ON s.joint = u.next),\nbrest AS (SELECT u.joint, sum(s.oy) AS y FROM bup u JOIN bare s ON s.joint = u.ancestor GROUP BY u.joint),\ntip AS (SELECT y FROM brest UNION ALL SELECT y + ey FROM brest JOIN bare USING (joint) WHERE ey IS NOT NULL)"


@query("AGG21", using("toy", recursive=True) + REST + f",\n{_BARE}{_BUP}\nSELECT 'toy' AS skeleton, " + m("(SELECT len FROM rest WHERE joint = 4) + (SELECT len FROM rest WHERE joint = 13)", "height") + " UNION ALL SELECT 'bare', " + m("max(y) - min(y)", "height") + " FROM tip")
def agg21(spark, sf):
    """Heights: of a humanoid by its chains, of other skeletons by their extent, end sites included."""
    ends = [(j, *BARE_ENDS.get(j, (None,) * 3)) for j in range(len(BARE))]
    bare = skeleton(spark, BARE).join(spark.createDataFrame(ends, "joint int, ex double, ey double, ez double"), "joint")
    of = lambda label, joints: H.skeleton_height(spark, joints).select(F.lit(label).alias("skeleton"), micro(F.col("height"), "height"))
    return of("toy", skeleton(spark, TOY)).unionByName(of("bare", bare))


# --- keys -------------------------------------------------------------------------------------

KEYS6 = using("scalar_track", recursive=True) + """,
tr AS (SELECT clip, list(v ORDER BY frame) AS v, count(*)::INTEGER AS n, greatest((max(v) - min(v)) * 0.05, 1e-12) AS bound FROM scalar_track GROUP BY clip),
seg AS (
  SELECT clip, 0 AS a, n - 1 AS b FROM tr WHERE n > 1 AND list_max(list_transform(v, lambda x: abs(x - v[1]))) > bound
  UNION ALL
  SELECT clip, CASE WHEN k = 0 THEN a ELSE w END, CASE WHEN k = 0 THEN w ELSE b END FROM (
    SELECT clip, a, b, bound, list_max(e) AS e, CAST(a + list_position(e, list_max(e)) AS INTEGER) AS w FROM (
      SELECT s.clip, s.a, s.b, t.bound, list_transform(range(s.a + 1, s.b), lambda i: abs(t.v[i+1] - (t.v[s.a+1] + (i - s.a)::DOUBLE / (s.b - s.a) * (t.v[s.b+1] - t.v[s.a+1])))) AS e
      FROM seg s JOIN tr t ON s.clip = t.clip WHERE s.b > s.a + 1)
  ) x, (VALUES (0), (1)) y(k) WHERE e > bound
),
key6 AS (SELECT clip, 0 AS frame FROM tr UNION SELECT clip, a FROM seg UNION SELECT clip, b FROM seg)
"""


def scalar_keys(spark, sf):
    return K.reduce_scalar_tracks(V.scalar_track(spark, sf), ["clip"], 0.05)


@query("REC6", KEYS6 + "SELECT clip, CAST(frame AS INTEGER) AS frame FROM key6")
def rec6(spark, sf):
    return scalar_keys(spark, sf).select("clip", "frame")


@query("COD2", KEYS6 + ",\nb AS (SELECT clip, min(v) AS lo, max(v) AS hi FROM scalar_track GROUP BY clip)\nSELECT k.clip, CAST(k.frame AS INTEGER) AS frame, CAST(round_even(least(1.0, greatest(0.0, (s.v-lo)/(hi-lo))) * 4095, 0) AS BIGINT) AS code FROM key6 k JOIN scalar_track s ON k.clip = s.clip AND k.frame = s.frame JOIN b ON b.clip = k.clip")
def cod2(spark, sf):
    """Kept keys with the codes of their values."""
    bounds = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return scalar_keys(spark, sf).join(bounds, "clip").select("clip", "frame", codes.quantize(F.col("v"), F.col("lo"), F.col("hi"), 12).alias("code"))


def _slerp_error() -> str:
    """The error in degrees of frame i of a track q against the slerp of its frames a and b, given d, th, sg of these ends."""
    wa = "CASE WHEN d > 0.9995 THEN 1 - (i - a)::DOUBLE / (b - a) ELSE sin((1 - (i - a)::DOUBLE / (b - a)) * th) / sin(th) END"
    wb = "CASE WHEN d > 0.9995 THEN (i - a)::DOUBLE / (b - a) ELSE sin((i - a)::DOUBLE / (b - a) * th) / sin(th) END * sg"
    part = lambda k: f"(({wa}) * q[a+1][{k}] + ({wb}) * q[b+1][{k}])"
    dot = " + ".join(f"q[i+1][{k}] * {part(k)}" for k in (1, 2, 3, 4))
    size = " + ".join(f"{part(k)} * {part(k)}" for k in (1, 2, 3, 4))
    return f"degrees(2 * acos(least(1.0::DOUBLE, abs({dot}) / sqrt({size}))))"


TURN_DEGREES = 60.0
_DOT = "(q[a+1][1]*q[b+1][1] + q[a+1][2]*q[b+1][2] + q[a+1][3]*q[b+1][3] + q[a+1][4]*q[b+1][4])"
KEYS5 = using("pose_quat", recursive=True) + f""",
tq AS (SELECT clip, joint, list([qw, qx, qy, qz] ORDER BY frame) AS q, count(*)::INTEGER AS n FROM pose_quat GROUP BY clip, joint),
seg5 AS (
  SELECT clip, joint, 0 AS a, n - 1 AS b FROM tq WHERE n > 1 AND list_max(list_transform(q, lambda x: degrees(2 * acos(least(1.0::DOUBLE, abs(x[1]*q[1][1] + x[2]*q[1][2] + x[3]*q[1][3] + x[4]*q[1][4])))))) > {TURN_DEGREES}
  UNION ALL
  SELECT clip, joint, CASE WHEN k = 0 THEN a ELSE w END, CASE WHEN k = 0 THEN w ELSE b END FROM (
    SELECT clip, joint, a, b, list_max(e) AS e, CAST(a + list_position(e, list_max(e)) AS INTEGER) AS w FROM (
      SELECT clip, joint, a, b, list_transform(range(a + 1, b), lambda i: {_slerp_error()}) AS e FROM (
        SELECT s.clip, s.joint, s.a, s.b, t.q, least(1.0::DOUBLE, abs({_DOT})) AS d, acos(least(1.0::DOUBLE, abs({_DOT}))) AS th, CASE WHEN {_DOT} < 0 THEN -1 ELSE 1 END AS sg
        FROM seg5 s JOIN tq t ON s.clip = t.clip AND s.joint = t.joint WHERE s.b > s.a + 1)))
  x, (VALUES (0), (1)) y(k) WHERE e > {TURN_DEGREES}
),
key5 AS (SELECT clip, joint, 0 AS frame FROM tq UNION SELECT clip, joint, a FROM seg5 UNION SELECT clip, joint, b FROM seg5)
"""


def rotation_keys(spark, sf):
    return K.reduce_rotation_tracks(V.pose_quat(spark, sf), ["clip", "joint"], TURN_DEGREES)


@query("REC5", KEYS5 + "SELECT clip, joint, CAST(frame AS INTEGER) AS frame FROM key5")
def rec5(spark, sf):
    """Rotation keys; the tables' poses are random, so the bound is wide to let frames go."""
    return rotation_keys(spark, sf).select("clip", "joint", "frame")


@query("COD1", KEYS5.rstrip() + S3.replace("FROM pose_quat)", "FROM pose_quat JOIN key5 USING (clip, joint, frame))").rstrip() + "\nSELECT clip, joint, count(*) AS keys, CAST(ceil(count(*) * 50 / 8.0) AS BIGINT) AS bytes, sum(c[1])::BIGINT AS check FROM three GROUP BY clip, joint")
def cod1(spark, sf):
    """Rotation keys with their smallest-three codes and the size of their section."""
    omitted, three = codes.smallest_three(Q.quat(), 16)
    rows = rotation_keys(spark, sf).select("clip", "joint", "frame", omitted.alias("omitted"), three.alias("codes"))
    return rows.groupBy("clip", "joint").agg(F.count("*").alias("keys"), codes.packed_bytes(F.count("*"), 50).alias("bytes"), F.sum(F.get("codes", F.lit(0))).alias("check"))


# --- mapping and retargeting --------------------------------------------------------------------

_RIG = "tgt AS (SELECT joint, 'rig:' || name AS name FROM toy UNION ALL VALUES (16, 'rig:Tail'), (17, 'b:Head'))"


def rigged(spark):
    rows = [(i, "rig:" + n) for i, (n, _, _) in enumerate(TOY)] + [(16, "rig:Tail"), (17, "b:Head")]
    return spark.createDataFrame(rows, "joint int, name string")


@query("JON3", using("toy") + f",\n{_RIG}\nSELECT CAST(t.joint AS INTEGER) AS target, CAST(min(s.joint) AS INTEGER) AS source FROM tgt t JOIN toy s ON trim(list_last(string_split(t.name, ':'))) = trim(list_last(string_split(s.name, ':'))) GROUP BY t.joint")
def jon3(spark, sf):
    return R.exact_mapping(skeleton(spark, TOY), rigged(spark))


_PLAIN = "regexp_replace(lower(list_last(string_split(name, ':'))), '[^a-z0-9]', '', 'g')"
_MAP = f""",
{ALIAS_SQL},
sm AS (SELECT joint, {_PLAIN} AS plain, {meaning_sql()} AS what FROM toy),
tm AS (SELECT joint, {_PLAIN} AS plain, {meaning_sql()} AS what FROM engine),
ss AS (SELECT joint, row_number() OVER (ORDER BY joint) - 1 AS rank, count(*) OVER () AS n FROM sm WHERE what = 'spine'),
st AS (SELECT joint, row_number() OVER (ORDER BY joint) - 1 AS rank, count(*) OVER () AS n FROM tm WHERE what = 'spine'),
sp AS (SELECT st.joint, ss.joint AS source FROM st JOIN ss ON ss.rank = round_even(st.rank * (ss.n - 1)::DOUBLE / greatest(1, st.n - 1), 0)),
al AS (SELECT what, min(joint) AS source FROM sm WHERE what <> 'spine' AND NOT starts_with(what, 'twist:') GROUP BY what HAVING count(*) = 1),
ex AS (SELECT plain, max(joint) AS source, max_by(what, joint) AS what FROM sm GROUP BY plain),
mp AS (SELECT t.joint AS target, coalesce(sp.source, CASE WHEN ex.what = t.what THEN ex.source END, al.source) AS source,
  CASE WHEN sp.source IS NOT NULL THEN 'normalized_chain' WHEN ex.what = t.what THEN 'exact_name' ELSE 'semantic_alias' END AS method
  FROM tm t LEFT JOIN sp USING (joint) LEFT JOIN ex ON ex.plain = t.plain LEFT JOIN al ON al.what = t.what)
"""


@query("JON4", using("toy", "engine") + _MAP + "SELECT CAST(target AS INTEGER) AS target, CAST(source AS INTEGER) AS source, method FROM mp WHERE source IS NOT NULL")
def jon4(spark, sf):
    return R.mapping(skeleton(spark, TOY), skeleton(spark, ENGINE))


@query("JON5", using("toy", "engine") + _MAP + "SELECT CAST(joint AS INTEGER) AS target, CAST(source AS INTEGER) AS source FROM sp")
def jon5(spark, sf):
    return R.spine_pairs(R.described(skeleton(spark, TOY)), R.described(skeleton(spark, ENGINE)))


@query("WIN7", using("toy", "engine") + _MAP + "SELECT 'toy' AS skeleton, CAST(joint AS INTEGER) AS joint, CAST(rank AS INTEGER) AS rank, n FROM ss UNION ALL SELECT 'engine', CAST(joint AS INTEGER), CAST(rank AS INTEGER), n FROM st")
def win7(spark, sf):
    ranks = lambda label, joints: R.spine_ranks(R.described(skeleton(spark, joints))).select(F.lit(label).alias("skeleton"), "joint", "rank", "n")
    return ranks("toy", TOY).unionByName(ranks("engine", ENGINE))


_DRIVER = "drv AS (SELECT joint, upper(name) AS name FROM toy UNION ALL VALUES (16, 'x:HEAD'))"


@query("JON13", using("toy") + f",\n{_RIG},\n{_DRIVER}\nSELECT CAST(t.joint AS INTEGER) AS target, CAST(max(d.joint) AS INTEGER) AS driver FROM tgt t JOIN drv d ON {_PLAIN.replace('name', 't.name')} = {_PLAIN.replace('name', 'd.name')} GROUP BY t.joint")
def jon13(spark, sf):
    """Which bone drives which: names differ in case and name space, and one name stands twice."""
    rows = [(i, n.upper()) for i, (n, _, _) in enumerate(TOY)] + [(16, "x:HEAD")]
    return R.driver_bones(spark.createDataFrame(rows, "joint int, name string"), rigged(spark))


@query("AGG22", using("toy", "engine") + _MAP + ",\ncore AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in names.CORE) + "]) AS what), sh AS (SELECT what FROM core INTERSECT SELECT what FROM sm INTERSECT SELECT what FROM tm)\nSELECT count(*) AS shared, count(*) FILTER (WHERE what IN (SELECT t.what FROM mp JOIN tm t ON t.joint = mp.target WHERE mp.source IS NOT NULL)) AS mapped FROM sh")
def agg22(spark, sf):
    s, t = skeleton(spark, TOY), skeleton(spark, ENGINE)
    return R.coverage(s, t, R.mapping(s, t))


@query("SET2", using("toy", "engine") + _MAP + "SELECT what FROM sm INTERSECT SELECT what FROM tm")
def set2(spark, sf):
    return R.described(skeleton(spark, TOY)).select("what").intersect(R.described(skeleton(spark, ENGINE)).select("what"))


@query("JON9", using("toy", "engine") + _MAP + "SELECT CAST(e.joint AS INTEGER) AS joint, CAST(coalesce(mp.source, -1) AS INTEGER) AS source, mp.source IS NOT NULL AS driven FROM engine e LEFT JOIN mp ON mp.target = e.joint")
def jon9(spark, sf):
    s, t = skeleton(spark, TOY), skeleton(spark, ENGINE)
    pairs = F.broadcast(R.mapping(s, t).select(F.col("target").alias("joint"), "source"))
    return t.join(pairs, "joint", "left").select("joint", F.coalesce("source", F.lit(-1)).alias("source"), F.col("source").isNotNull().alias("driven"))


def profile(spark):
    return R.build_profile(skeleton(spark, TOY), skeleton(spark, ENGINE))


def _arrays(joints):
    what = ["pelvis" if n in ("Hips", "pelvis") else "root" if n == "root" else "" for n, _, _ in joints]
    return R.Skeleton([n for n, _, _ in joints], [p for _, p, _ in joints], np.array([o for _, _, o in joints], float), what)


def _pairs_sql() -> str:
    """The transfers as literals: rest frames come from NumPy, everything that moves is SQL."""
    s, t = _arrays(TOY), _arrays(ENGINE)
    source = {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9, 12: 10, 13: 11, 14: 12, 15: 13, 16: 14, 17: 15}
    rows = []
    for k, j in source.items():
        b = np.array([1.0, 0, 0, 0]) if k == 6 else R.matrix_quaternion(t.basis(k, 1) @ s.basis(j, 1).T)
        rows.append(f"({k}, {j}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in b) + ")")
    return "pr AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(target, source, bw, bx, \"by\", bz))"


_B, _GS = ["r.bw", "r.bx", 'r."by"', "r.bz"], ["f.gw", "f.gx", "f.gy", "f.gz"]
_D = _mul(_mul(_B, _GS), ["r.bw", "(-r.bx)", '(-r."by")', "(-r.bz)"])
_LOC = _mul(["u.dw", "(-u.dx)", "(-u.dy)", "(-u.dz)"], ["d.dw", "d.dx", "d.dy", "d.dz"])
RET5 = FK.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_pairs_sql()}, ", 1) + f""",
engine AS ({using('engine').split('engine AS (', 1)[1]},
d AS (SELECT f.clip, f.frame, r.target AS joint, {_D[0]} AS dw, {_D[1]} AS dx, {_D[2]} AS dy, {_D[3]} AS dz FROM fk f JOIN pr r ON f.joint = r.source),
w AS (SELECT c.clip, c.frame, e.joint, e.parent, d.joint IS NOT NULL AS driven, coalesce(d.dw, 1) AS dw, coalesce(d.dx, 0) AS dx, coalesce(d.dy, 0) AS dy, coalesce(d.dz, 0) AS dz
  FROM clip_frame c, engine e LEFT JOIN d ON d.clip = c.clip AND d.frame = c.frame AND d.joint = e.joint)
"""
_RET_OUT = "SELECT d.clip, d.frame, CAST(d.joint AS INTEGER) AS joint, " + ", ".join(
    m(f"CASE WHEN d.driven THEN {x} ELSE {i} END", f"q{c}", "1e5") for x, c, i in zip(_LOC, "wxyz", (1, 0, 0, 0), strict=True)
) + " FROM w d JOIN w u ON u.clip = d.clip AND u.frame = d.frame AND u.joint = greatest(d.parent, 0) WHERE d.parent >= 0"


@query("RET5", RET5 + _RET_OUT)
def ret5(spark, sf):
    rows = R.retarget(poses(spark, sf), profile(spark)).where("joint > 0")
    return rows.select("clip", "frame", "joint", *[micro(F.col(f"q{c}"), f"q{c}", 1e5) for c in "wxyz"])


@query("REC7", RET5 + "SELECT clip, frame, CAST(joint AS INTEGER) AS joint, " + ", ".join(m(f"d{c}", f"d{c}", "1e5") for c in "wxyz") + " FROM w WHERE driven")
def rec7(spark, sf):
    """Global rotations of the driven joints: the target's own walk over its local rotations gives them back."""
    p = profile(spark)
    g = H.forward_kinematics(R.retarget_poses(poses(spark, sf), p), p.target.parents, p.target.offsets)
    return g.where(F.col("joint").isin(*p.pairs)).select("clip", "frame", "joint", *[micro(F.col(f"g{c}"), f"d{c}", 1e5) for c in "wxyz"])


@query("RET2", using("toy", "engine") + _MAP + "SELECT count(source) AS pairs, count(*) FILTER (WHERE method = 'exact_name') AS exact, count(*) FILTER (WHERE method = 'normalized_chain') AS chain FROM mp")
def ret2(spark, sf):
    p = profile(spark)
    ways = [w for _, _, w in p.pairs.values()]
    return spark.createDataFrame([(len(ways), ways.count("exact_name"), ways.count("normalized_chain"))], "pairs long, exact long, chain long")


def _rest_axes():
    """The engine's rest frames, worked out by hand from its offsets: where the bone points (x) and the way across (z)."""
    r = lambda *v: np.array(v, float) / np.linalg.norm(v)
    X, Y, Z = np.eye(3)
    bone = {0: Y, 1: Y, 2: Y, 3: Y, 4: r(0, 1.8, 0.6), 5: Y, 6: Y, 7: X, 8: X, 9: X, 10: -X, 11: -X, 12: -X, 13: -Y, 14: r(0, -4.8, 0.6), 15: r(0, -4.8, 0.6), 16: -Y, 17: -Y}
    # a joint that goes on as it came looks to its other bones first, then to the axes
    hint = {0: [X], 1: [r(1.2, -0.6, 0), X], 2: [X], 3: [X], 4: [Y], 5: [r(0, 1.8, 0.6)], 6: [X], 7: [r(1.8, 1.2, 0)], 8: [Y], 9: [Y], 10: [r(-1.8, 1.2, 0)], 11: [Y], 12: [Y], 13: [r(1.2, -0.6, 0)], 14: [-Y], 15: [X], 16: [r(-1.2, -0.6, 0)], 17: [X]}
    for j, x in bone.items():
        z = np.cross(x, hint[j][0])
        z = z / np.linalg.norm(z)
        yield j, np.stack([x, np.cross(z, x), z], axis=1)


@query("RET3", "SELECT * FROM (VALUES " + ", ".join(f"({j}, " + ", ".join(f"CAST({round(float(v) * 1e6)} AS BIGINT)" for v in f.ravel()) + ")" for j, f in _rest_axes()) + ") v(joint, " + ", ".join(f"m{i}{k}" for i in range(3) for k in range(3)) + ")")
def ret3(spark, sf):
    """The rest frames of the engine's joints as columns x, y, z of a matrix."""
    t = R.Skeleton.of(skeleton(spark, ENGINE))
    rows = [(j, *(int(round(float(v) * 1e6)) for v in t.basis(j, 1).ravel())) for j in range(len(t.names))]
    return spark.createDataFrame(rows, "joint int, " + ", ".join(f"m{i}{j} long" for i in range(3) for j in range(3)))


@query("RET4", "WITH t AS (SELECT p_partkey AS id, CAST(p_partkey % 20 AS INTEGER) AS target, CAST(p_size % 18 - 1 AS INTEGER) AS source, CASE WHEN p_partkey % 7 = 0 THEN 1.1 ELSE 0.8 END::DOUBLE AS bw, 0.6::DOUBLE AS bx FROM part)\nSELECT id, concat_ws(',', CASE WHEN target >= 18 THEN 'target' END, CASE WHEN source < 0 OR source >= 16 THEN 'source' END, CASE WHEN abs(sqrt(bw*bw+bx*bx) - 1) > 1e-5 THEN 'basis' END) AS violations FROM t")
def ret4(spark, sf):
    """What keeps transfers out of a compiled profile; the parts make up transfers, some out of range or with a basis that is no rotation."""
    k, zero = F.col("p_partkey"), F.lit(0.0)
    rows = V.table(spark, sf, "part").select(
        k.alias("id"), (k % 20).cast("int").alias("target"), (F.col("p_size") % 18 - 1).cast("int").alias("source"),
        F.when(k % 7 == 0, 1.1).otherwise(0.8).alias("bw"), F.lit(0.6).alias("bx"), zero.alias("by"), zero.alias("bz"),
    )
    return R.transfer_violations(rows, len(TOY), len(ENGINE)).select("id", F.array_join("violations", ",").alias("violations"))


@query("RET6", RET5 + "SELECT * FROM (" + _RET_OUT + ") WHERE frame = 3")
def ret6(spark, sf):
    """One frame: the filter reaches the poses, since a pose is a row."""
    rows = R.retarget(poses(spark, sf).where("frame = 3"), profile(spark)).where("joint > 0")
    return rows.select("clip", "frame", "joint", *[micro(F.col(f"q{c}"), f"q{c}", 1e5) for c in "wxyz"])


@query("RET7", RET5 + "SELECT clip, frame, CAST(joint AS INTEGER) AS joint, " + ", ".join([m("1-2*(dy*dy+dz*dz)", "m00", "1e5"), m("2*(dx*dy+dw*dz)", "m10", "1e5"), m("2*(dx*dz-dw*dy)", "m20", "1e5"), m("1-2*(dx*dx+dy*dy)", "m22", "1e5")]) + " FROM w WHERE driven")
def ret7(spark, sf):
    """Global rotations of the driven joints by matrix products, the reference form of the retarget."""
    p = profile(spark)
    driven = sorted(p.pairs)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            g = p.run_matrices(H.flat(b.column(2), 4))[:, driven]
            at = pa.array(np.repeat(np.arange(len(g)), len(driven)))
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(np.tile(np.array(driven, np.int32), len(g)))]
            cols += [pa.array(np.ascontiguousarray(g[..., i, j]).ravel()) for i, j in ((0, 0), (1, 0), (2, 0), (2, 2))]
            yield pa.RecordBatch.from_arrays(cols, names=["clip", "frame", "joint", "m00", "m10", "m20", "m22"])

    out = poses(spark, sf).mapInArrow(run, "clip int, frame int, joint int, m00 double, m10 double, m20 double, m22 double")
    return out.select("clip", "frame", "joint", *[micro(F.col(c), c, 1e5) for c in ("m00", "m10", "m20", "m22")])


_RATIO = 1.5


@query("RET1", using("pose_quat", "toy") + f",\n{_RIG},\nj AS (SELECT t.joint AS target, min(s.joint) AS source FROM tgt t LEFT JOIN toy s ON trim(list_last(string_split(t.name, ':'))) = s.name GROUP BY t.joint)\nSELECT c.clip, c.frame, CAST(j.target AS INTEGER) AS joint, " + ", ".join(m(f"coalesce(p.q{c}, {i})", f"q{c}") for c, i in zip("wxyz", (1, 0, 0, 0), strict=True)) + ", " + m(f"CASE WHEN j.target = 0 THEN ({OFFSETS[0][0]} + c.frame * 0.25::DOUBLE) * {_RATIO} END", "root_x") + " FROM clip_frame c CROSS JOIN j LEFT JOIN pose_quat p ON p.clip = c.clip AND p.frame = c.frame AND p.joint = j.source")
def ret1(spark, sf):
    """Rotations copied by name, joints without a source at rest, the root's position times the ratio of heights. All stays in the row."""
    pairs = {r["target"]: r["source"] for r in R.exact_mapping(skeleton(spark, TOY), rigged(spark)).collect()}  # one skeleton
    rows = R.copy_rotations(moving_poses(spark, sf), pairs, 18, _RATIO)
    rows = rows.select("clip", "frame", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda j: F.slice("rotations", j * 4 + 1, 4))).alias("joint", "q"), F.get("root", F.lit(0)).alias("x"))
    return rows.select("clip", "frame", "joint", *[micro(F.get("q", F.lit(k)), "q" + c) for k, c in enumerate("wxyz")], micro(F.when(F.col("joint") == 0, F.col("x")), "root_x"))


_F = ["x", "y", "z"]
_ANCHOR = lambda k, c: f"CASE WHEN n.a{k} AND NOT p.a{k} THEN n.{c}{k} + p.c{c} ELSE p.h{c}{k} END"
_STEP = {c: f"CASE WHEN n.a0 AND n.a1 THEN ((({_ANCHOR(0, c)}) - n.{c}0) + (({_ANCHOR(1, c)}) - n.{c}1)) / 2 WHEN n.a0 THEN ({_ANCHOR(0, c)}) - n.{c}0 WHEN n.a1 THEN ({_ANCHOR(1, c)}) - n.{c}1 ELSE p.c{c} * 0.8 END" for c in _F}


@query("REC8", using("foot_contact", recursive=True) + f""",
two AS (SELECT a.clip, a.frame, a.active AS a0, b.active AS a1, {", ".join(f"a.{c} AS {c}0, b.{c} AS {c}1" for c in _F)} FROM foot_contact a JOIN foot_contact b ON a.clip = b.clip AND a.frame = b.frame WHERE a.foot = 3 AND b.foot = 7),
c8 AS (
  SELECT clip, frame, a0, a1, {", ".join(f"{c}{k} AS h{c}{k}" for c in _F for k in (0, 1))}, {", ".join(f"0.0::DOUBLE AS c{c}" for c in _F)} FROM two WHERE frame = 0
  UNION ALL
  SELECT n.clip, n.frame, n.a0, n.a1, {", ".join(_ANCHOR(k, c) for c in _F for k in (0, 1))}, {", ".join(_STEP[c] for c in _F)}
  FROM c8 p JOIN two n ON n.clip = p.clip AND n.frame = p.frame + 1
)
SELECT clip, frame, {", ".join(m("c" + c, "c" + c, "1e5") for c in _F)} FROM c8""")
def rec8(spark, sf):
    """The contact lock of two feet in space: what holds the feet that are down, on average, and fades without one."""
    return R.foot_lock(foot_contact(spark, sf)).select("clip", "frame", *[micro(F.col("c" + c), "c" + c, 1e5) for c in _F])


# --- samples ------------------------------------------------------------------------------------

_TIME = ",\ns AS (SELECT st.sample, st.clip, st.t, ts.n, CASE WHEN n > 1 THEN t - (n-1)*floor(t/(n-1)) ELSE 0 END AS looped, least(greatest(t, 0), (n-1)::DOUBLE) AS held FROM sample_times st JOIN track_size ts ON ts.clip = st.clip)"


def timed(spark, sf):
    return V.sample_times(spark, sf).join(V.track_size(spark, sf), "clip")


@query("PRJ25", using("sample_times", "track_size") + _TIME + "\nSELECT sample, " + m("looped", "looped") + ", " + m("held", "held") + ", CAST(least(floor(looped), n - 1) AS INTEGER) AS frame FROM s")
def prj25(spark, sf):
    rows = timed(spark, sf)
    loop, hold = (resample.clip_time(F.col("t"), F.col("n"), 1.0, x) for x in (True, False))
    return rows.select("sample", micro(loop, "looped"), micro(hold, "held"), F.least(F.floor(loop), F.col("n") - 1).cast("int").alias("frame"))


_BR = ",\nb AS (SELECT sample, clip, n, CAST(least(floor(looped), n-1) AS INTEGER) AS frame, CAST(least(least(floor(looped), n-1) + 1, n-1) AS INTEGER) AS nxt, looped - least(floor(looped), n-1) AS share FROM s)\n"


@query("JON7", using("sample_times", "track_size", "scalar_track") + _TIME + _BR + "SELECT sample, b.frame, b.nxt AS next, " + m("x.v", "va") + ", " + m("y.v", "vb") + " FROM b JOIN scalar_track x ON x.clip = b.clip AND x.frame = b.frame JOIN scalar_track y ON y.clip = b.clip AND y.frame = b.nxt")
def jon7(spark, sf):
    rows = resample.sample_scalars(timed(spark, sf), V.scalar_track(spark, sf), 1.0, True)
    return rows.select("sample", "frame", "next", micro(F.col("va"), "va"), micro(F.col("vb"), "vb"))


#: Samples of poses: the orders name a clip and a time that may lie outside of it.
_ST = "st AS (SELECT o_orderkey AS sample, CAST(o_custkey % 10 AS INTEGER) AS clip, (o_orderkey % 1000) * 0.1::DOUBLE - 10.0::DOUBLE AS t FROM orders), cn AS (SELECT clip, CAST(count(*) AS INTEGER) AS n FROM clip_frame GROUP BY clip), sl AS (SELECT sample, st.clip, n, t - (n-1)*floor(t/(n-1)) AS tt FROM st JOIN cn ON cn.clip = st.clip), sb AS (SELECT sample, clip, CAST(least(floor(tt), n-1) AS INTEGER) AS frame, CAST(least(least(floor(tt), n-1) + 1, n-1) AS INTEGER) AS nxt, tt - least(floor(tt), n-1) AS u FROM sl)"
_ND = "abs(x.qw*y.qw + x.qx*y.qx + x.qy*y.qy + x.qz*y.qz)"
_SS = f"""sp AS (SELECT sample, x.joint, b.frame, b.u, least(1.0::DOUBLE, {_ND}) AS d, CASE WHEN x.qw*y.qw + x.qx*y.qx + x.qy*y.qy + x.qz*y.qz < 0 THEN -1 ELSE 1 END AS sg, {", ".join(f"x.q{c} AS h{c}, y.q{c} AS k{c}" for c in "wxyz")}
  FROM sb b JOIN pose_quat x ON x.clip = b.clip AND x.frame = b.frame JOIN pose_quat y ON y.clip = b.clip AND y.frame = b.nxt AND y.joint = x.joint),
sw AS (SELECT *, CASE WHEN d > 0.9995 THEN 1 - u ELSE sin((1 - u) * acos(d)) / sin(acos(d)) END AS wa, CASE WHEN d > 0.9995 THEN u ELSE sin(u * acos(d)) / sin(acos(d)) END * sg AS wb FROM sp),
sq AS (SELECT sample, joint, frame, u, {", ".join(f"wa*h{c} + wb*k{c} AS r{c}" for c in "wxyz")} FROM sw)"""
_RN = "sqrt(rw*rw+rx*rx+ry*ry+rz*rz)"


def pose_samples(spark, sf):
    """(sample, clip, t, n): a time of a clip for each order."""
    sizes = V.table(spark, sf, "embeddings").groupBy(F.col("label").alias("clip")).agg(F.count("*").cast("int").alias("n"))
    rows = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 10).cast("int").alias("clip"), ((F.col("o_orderkey") % 1000) * F.lit(0.1) - F.lit(10.0)).alias("t"))
    return rows.join(F.broadcast(sizes), "clip")  # a row a clip


def joints_of(poses_, keys):
    """(keys, joint, qw..qz, tx..tz) from pose rows."""
    at = lambda c, j, k, w: F.get(c, j * w + k)
    rows = poses_.select(*keys, "rotations", "translations", F.explode(F.sequence(F.lit(0), (F.size("rotations") / 4 - 1).cast("int"))).alias("joint"))
    return rows.select(*keys, "joint", *[at("rotations", F.col("joint"), k, 4).alias("q" + c) for k, c in enumerate("wxyz")], *[at("translations", F.col("joint"), k, 3).alias("t" + c) for k, c in enumerate("xyz")])


@query("SMP2", using("pose_quat", "clip_frame") + f",\n{_ST},\n{_SS}\nSELECT sample, CAST(joint AS INTEGER) AS joint, " + ", ".join(m(f"r{c}/{_RN}", f"q{c}", "1e5") for c in "wxyz") + ", " + m("CASE WHEN joint = 0 THEN (frame + u) * 0.25::DOUBLE ELSE 0 END", "moved", "1e5") + " FROM sq")
def smp2(spark, sf):
    """Whole poses at looped times: slerp of all joints and the root's way."""
    rows = joints_of(resample.sample_poses(pose_samples(spark, sf), moving_poses(spark, sf), 1.0, True), ["sample"])
    moved = F.when(F.col("joint") == 0, F.col("tx") - F.lit(OFFSETS[0][0])).otherwise(0.0)
    return rows.select("sample", "joint", *[micro(F.col("q" + c), "q" + c, 1e5) for c in "wxyz"], micro(moved, "moved", 1e5))


@query("SMP1", using("pose_quat", "clip_frame") + f",\n{_ST}\nSELECT sample, st.clip, p.frame, CAST(p.joint AS INTEGER) AS joint, " + ", ".join(m(f"p.q{c}", f"q{c}") for c in "wxyz") + ", " + m("CASE WHEN p.joint = 0 THEN p.frame * 0.25::DOUBLE ELSE 0 END", "moved") + " FROM st JOIN pose_quat p ON p.clip = st.clip AND p.frame = CAST(floor(st.t) AS BIGINT)")
def smp1(spark, sf):
    """Whole poses of frames; samples outside of their clip give none."""
    at = pose_samples(spark, sf).withColumn("frame", F.floor("t").cast("int"))
    rows = joints_of(resample.sample_frames(at, moving_poses(spark, sf)), ["sample", "clip", "frame"])
    moved = F.when(F.col("joint") == 0, F.col("tx") - F.lit(OFFSETS[0][0])).otherwise(0.0)
    return rows.select("sample", "clip", "frame", "joint", *[micro(F.col("q" + c), "q" + c) for c in "wxyz"], micro(moved, "moved"))


@query("SMP3", using("track_size", "toy") + "\nSELECT clip, n AS frames, " + m("(n - 1) / 30.0::DOUBLE", "duration") + ", (SELECT count(*) FROM toy) AS joints, (SELECT name FROM toy WHERE joint = 4) AS name FROM track_size")
def smp3(spark, sf):
    j = skeleton(spark, TOY).agg(F.count("*").alias("joints"), F.max(F.when(F.col("joint") == 4, F.col("name"))).alias("name"))
    rows = V.track_size(spark, sf).join(F.broadcast(j))  # one row
    return rows.select("clip", F.col("n").alias("frames"), micro((F.col("n") - 1) / F.lit(30.0), "duration"), "joints", "name")


# --- other joins --------------------------------------------------------------------------------

@query("JON1", using("pred_truth") + "\nSELECT clip, count(*) AS rows, count(DISTINCT frame) AS frames, count(DISTINCT joint) AS joints FROM pred_truth GROUP BY clip")
def jon1(spark, sf):
    return V.pred_truth(spark, sf).groupBy("clip").agg(F.count("*").alias("rows"), F.count_distinct("frame").alias("frames"), F.count_distinct("joint").alias("joints"))


@query("JON2", "WITH p AS (SELECT o_orderkey || '.bvh' AS path FROM orders), t AS (SELECT o_orderkey || '_gt.bvh' AS path FROM orders WHERE o_orderkey % 10 <> 0)\nSELECT count(*) AS predictions, count(t.path) AS matched, count(*) - count(t.path) AS missing FROM p LEFT JOIN t ON regexp_replace(p.path, '\\.bvh$', '') = regexp_replace(t.path, '_gt\\.bvh$', '')")
def jon2(spark, sf):
    keys = V.table(spark, sf, "orders").select("o_orderkey")
    p = keys.select(F.concat("o_orderkey", F.lit(".bvh")).alias("path"))
    t = keys.where("o_orderkey % 10 <> 0").select(F.concat("o_orderkey", F.lit("_gt.bvh")).alias("path"))
    stem = lambda d, end: d.select(F.regexp_replace("path", end, "").alias("stem"))
    both = stem(p, r"\.bvh$").join(stem(t, r"_gt\.bvh$").withColumn("hit", F.lit(1)), "stem", "left")
    return both.agg(F.count("*").alias("predictions"), F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("missing"))


_PIN = "clips AS (SELECT DISTINCT user_id AS clip, md5((user_id % 5)::VARCHAR) AS source FROM events), prof AS (SELECT md5(i::VARCHAR) AS source, 't' || j AS target FROM range(0, 4) a(i), range(0, 2) b(j))"


def pins(spark, sf):
    clips = V.table(spark, sf, "events").select(F.col("user_id").alias("clip")).distinct()
    prof = spark.createDataFrame([(i, f"t{j}") for i in range(4) for j in range(2)], "i long, target string")
    return clips.withColumn("source", F.md5((F.col("clip") % 5).cast("string"))), prof.select(F.md5(F.col("i").cast("string")).alias("source"), "target")


@query("JON10", f"WITH {_PIN}\nSELECT clip, target FROM clips JOIN prof USING (source)")
def jon10(spark, sf):
    clips, prof = pins(spark, sf)
    return clips.join(F.broadcast(prof), "source").select("clip", "target")  # a profile table is a few rows


@query("FLT10", f"WITH {_PIN}\nSELECT clip, source FROM clips WHERE source NOT IN (SELECT source FROM prof)")
def flt10(spark, sf):
    clips, prof = pins(spark, sf)
    return clips.join(F.broadcast(prof), "source", "left_anti").select("clip", "source")


@query("JON11", "SELECT s.i AS source, t.i AS target FROM range(0, 4) s(i), range(0, 4) t(i) UNION ALL SELECT 9, t.i FROM range(0, 4) t(i)")
def jon11(spark, sf):
    """Pairs of characters: four by four, and one more by four."""
    four = spark.range(4)
    grid = four.select(F.col("id").alias("source")).crossJoin(four.select(F.col("id").alias("target")))
    return grid.union(four.select(F.lit(9).cast("long"), F.col("id")))


@query("JON12", using("pose_quat") + "\nSELECT clip, count(*) AS n, " + m("max(degrees(2*acos(least(1.0::DOUBLE, abs((qw*round(qw,3)+qx*round(qx,3)+qy*round(qy,3)+qz*round(qz,3)) / sqrt(round(qw,3)*round(qw,3)+round(qx,3)*round(qx,3)+round(qy,3)*round(qy,3)+round(qz,3)*round(qz,3)))))))", "worst", "1e3") + " FROM pose_quat GROUP BY clip")
def jon12(spark, sf):
    """A clip against a copy of it in thousandths, joined on frame and joint."""
    a = V.pose_quat(spark, sf)
    b = a.select("clip", "frame", "joint", *[F.round(f"q{c}", 3).alias(f"b{c}") for c in "wxyz"])
    e = Q.angle_degrees(Q.quat(), Q.quat("b"))
    return a.join(b, ["clip", "frame", "joint"]).groupBy("clip").agg(F.count("*").alias("n"), micro(F.max(e), "worst", 1e3))


