"""Row-level operators (PRJ): quaternions, quantisers, names, times."""

from __future__ import annotations

from pyspark.sql import functions as F

from posegrid.functions import codes, names
from posegrid.functions import quat as Q
from posegrid.plans import views as V
from posegrid.plans.registry import ENGINE, TOY, m, micro, query, skeleton, using

KEY = ["clip", "frame", "joint"]
PAIR = "SELECT clip, frame, joint, "
PQ, PP = using("pose_quat") + "\n", using("quat_pair") + "\n"


def four(q, prefix="r"):
    return [micro(c, prefix + n) for c, n in zip(q, "wxyz", strict=True)]


def four_sql(parts, prefix="r"):
    return ", ".join(m(p, prefix + n) for p, n in zip(parts, "wxyz", strict=True))


@query("PRJ1", using("raw_quat") + "\n" + PAIR + four_sql([f"{c}0/sqrt(w0*w0+x0*x0+y0*y0+z0*z0)" for c in "wxyz"]) + " FROM raw_quat WHERE sqrt(w0*w0+x0*x0+y0*y0+z0*z0) > 1e-12")
def normalize(spark, sf):
    raw = tuple(F.col(c + "0") for c in "wxyz")
    return V.raw_quat(spark, sf).where(Q.length(raw) > Q.SHORTEST).select(*KEY, *four(Q.normalize(raw)))


MUL = ["aw*bw-ax*bx-ay*\"by\"-az*bz", "aw*bx+ax*bw+ay*bz-az*\"by\"", "aw*\"by\"-ax*bz+ay*bw+az*bx", "aw*bz+ax*\"by\"-ay*bx+az*bw"]


@query("PRJ2", PP + PAIR + four_sql(MUL) + " FROM quat_pair")
def multiply(spark, sf):
    return V.quat_pair(spark, sf).select(*KEY, *four(Q.multiply(Q.quat("a"), Q.quat("b"))))


@query("PRJ3", PQ + PAIR + four_sql(["qw", "-qx", "-qy", "-qz"]) + " FROM pose_quat")
def conjugate(spark, sf):
    return V.pose_quat(spark, sf).select(*KEY, *four(Q.conjugate(Q.quat())))


@query("PRJ4", using("scalar_track") + "\nSELECT clip, frame, " + ", ".join([m("cos(v/100/2)", "c"), m("sin(v/100/2)", "s"), m("sin(v/100/2) * sin(v/100/2) + cos(v/100/2) * cos(v/100/2)", "one")]) + " FROM scalar_track")
def axis_angle(spark, sf):
    q = Q.axis_angle("Y", F.col("v") / 100)
    return V.scalar_track(spark, sf).select("clip", "frame", micro(q[0], "c"), micro(q[2], "s"), micro(Q.dot(q, q), "one"))


def _euler_sql(order: str) -> str:
    """Nested products written out for one order; angles a0, a1, a2."""
    out = []
    for k, axis in enumerate(order):
        c, s = f"cos(a{k}/2)", f"sin(a{k}/2)"
        out.append([c, *(s if axis == x else "0.0::DOUBLE" for x in "XYZ")])

    def mul(a, b):
        (aw, ax, ay, az), (bw, bx, by, bz) = a, b
        t = lambda *p: "(" + "".join(p) + ")"
        return [
            t(aw, "*", bw, "-", ax, "*", bx, "-", ay, "*", by, "-", az, "*", bz), t(aw, "*", bx, "+", ax, "*", bw, "+", ay, "*", bz, "-", az, "*", by),
            t(aw, "*", by, "-", ax, "*", bz, "+", ay, "*", bw, "+", az, "*", bx), t(aw, "*", bz, "+", ax, "*", by, "-", ay, "*", bx, "+", az, "*", bw),
        ]

    return mul(mul(out[0], out[1]), out[2])


ORDERS = ["XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX"]
_angles = "SELECT clip, frame, joint, qx*1.2 AS a0, qy*1.2 AS a1, qz*1.2 AS a2 FROM pose_quat WHERE joint = 3"


@query("PRJ5", PQ.rstrip() + f",\nang AS ({_angles})\n" + " UNION ALL ".join(f"SELECT '{o}' AS axes, clip, frame, {four_sql(_euler_sql(o))} FROM ang" for o in ORDERS))
def euler(spark, sf):
    """All six orders of the same angles: half angles, products and their lengths each in a select of its own."""
    rows = V.pose_quat(spark, sf).where("joint = 3")
    rows = rows.select("clip", "frame", *[f(F.col(f"q{c}") * 1.2 / 2).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.cos, "c"), (F.sin, "s"))])
    halves = [(F.col(f"c{c}"), F.col(f"s{c}")) for c in "xyz"]
    each = F.array(*[F.struct(F.lit(o).alias("axes"), *Q.named(Q.turns(o, halves))) for o in ORDERS])
    return rows.select("clip", "frame", F.inline(each)).select("axes", "clip", "frame", *four(Q.normalize(Q.quat())))


MAT = [
    ["1-2*(qy*qy+qz*qz)", "2*(qx*qy-qz*qw)", "2*(qx*qz+qy*qw)"],
    ["2*(qx*qy+qz*qw)", "1-2*(qx*qx+qz*qz)", "2*(qy*qz-qx*qw)"],
    ["2*(qx*qz-qy*qw)", "2*(qy*qz+qx*qw)", "1-2*(qx*qx+qy*qy)"],
]


@query("PRJ6", PQ + PAIR + ", ".join(m(MAT[i][j], f"m{i}{j}") for i in range(3) for j in range(3)) + " FROM pose_quat")
def matrix(spark, sf):
    mat = Q.to_matrix(Q.quat())
    return V.pose_quat(spark, sf).select(*KEY, *[micro(mat[i][j], f"m{i}{j}") for i in range(3) for j in range(3)])


@query("PRJ7", PQ + PAIR + four_sql([f"q{c} * CASE WHEN 4*qw*qw-1 > 0 THEN sign(qw) WHEN qx*qx >= qy*qy AND qx*qx >= qz*qz THEN sign(qx) WHEN qy*qy >= qz*qz THEN sign(qy) ELSE sign(qz) END" for c in "wxyz"]) + " FROM pose_quat")
def from_matrix(spark, sf):
    """Through the matrix and back: the quaternion with the chosen component positive."""
    rows, mat = V.pose_quat(spark, sf), Q.to_matrix(Q.quat())
    rows = rows.select(*KEY, *[mat[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    back = Q.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return rows.select(*KEY, *Q.named(back)).select(*KEY, *four(Q.normalize(Q.quat())))


def slerp_sql(a, b, u):
    """Four expressions from component names, by the same two arms."""
    d = "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True)) + ")"
    c, sg = f"least(1.0::DOUBLE, abs({d}))", f"(CASE WHEN {d} < 0 THEN -1 ELSE 1 END)"
    wa = f"(CASE WHEN {c} > 0.9995 THEN 1-({u}) ELSE sin((1-({u}))*acos({c}))/sin(acos({c})) END)"
    wb = f"(CASE WHEN {c} > 0.9995 THEN ({u}) ELSE sin(({u})*acos({c}))/sin(acos({c})) END)"
    raw = [f"({wa}*{x}+{wb}*{sg}*{y})" for x, y in zip(a, b, strict=True)]
    return raw, "sqrt(" + "+".join(f"{r}*{r}" for r in raw) + ")"


A, B = ["aw", "ax", "ay", "az"], ["bw", "bx", '"by"', "bz"]
_raw, _norm = slerp_sql(A, B, "0.3::DOUBLE")


@query("PRJ8", PP + PAIR + four_sql([f"{r}/{_norm}" for r in _raw]) + " FROM quat_pair")
def slerp(spark, sf):
    return V.quat_pair(spark, sf).select(*KEY, *four(Q.slerp(Q.quat("a"), Q.quat("b"), F.lit(0.3))))


@query("PRJ9", PQ + PAIR + ", ".join([m("CASE WHEN free THEN atan2(-s*mjk, mkk) ELSE atan2(s*mkj, mjj) END", "a0", "1e5"), m("asin(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, s*mik)))", "a1", "1e5"), m("CASE WHEN free THEN atan2(-s*mij, mii) ELSE 0 END", "a2", "1e5")])
       + f" FROM (SELECT *, sqrt(mii*mii+mij*mij) > 1e-9 AS free FROM (SELECT clip, frame, joint, 1.0::DOUBLE AS s, {MAT[2][1]} AS mik, {MAT[2][2]} AS mii, {MAT[2][0]} AS mij, {MAT[0][1]} AS mjk, {MAT[1][1]} AS mkk, {MAT[1][0]} AS mkj, {MAT[0][0]} AS mjj FROM pose_quat))")
def to_euler(spark, sf):
    angles = Q.to_euler(Q.quat(), "ZXY")
    return V.pose_quat(spark, sf).select(*KEY, *[micro(a, f"a{k}", 1e5) for k, a in enumerate(angles)])


@query("PRJ10", PP + PAIR + m("degrees(2*acos(least(1.0::DOUBLE, abs(aw*bw+ax*bx+ay*\"by\"+az*bz))))", "error", "1e4") + " FROM quat_pair")
def angle(spark, sf):
    return V.quat_pair(spark, sf).select(*KEY, micro(Q.angle_degrees(Q.quat("a"), Q.quat("b")), "error", 1e4))


S3 = """,
s AS (SELECT *, [qw, qx, qy, qz] AS q, list_position([abs(qw), abs(qx), abs(qy), abs(qz)], greatest(abs(qw), abs(qx), abs(qy), abs(qz))) AS p FROM pose_quat),
three AS (SELECT clip, frame, joint, p, list_transform(list_filter([1, 2, 3, 4], lambda i: i <> p), lambda i:
  CAST(round_even(least(1.0, greatest(0.0, (q[i] * CASE WHEN q[p] < 0 THEN -1 ELSE 1 END + 1/sqrt(2)) / (1/sqrt(2) + 1/sqrt(2)))) * 65535, 0) AS BIGINT)) AS c FROM s)
"""


@query("PRJ11", PQ.rstrip() + S3 + "SELECT clip, frame, joint, CAST(p - 1 AS INTEGER) AS omitted, c[1] AS c0, c[2] AS c1, c[3] AS c2 FROM three")
def smallest_three(spark, sf):
    omitted, three = codes.smallest_three(Q.quat(), 16)
    rows = V.pose_quat(spark, sf).select(*KEY, omitted.alias("omitted"), three.alias("c"))
    return rows.select(*KEY, "omitted", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(3)])


@query("PRJ12", PQ.rstrip() + S3.rstrip() + """,
v AS (SELECT *, list_transform(c, lambda x: -1/sqrt(2) + x / 65535.0::DOUBLE * (1/sqrt(2) + 1/sqrt(2))) AS v FROM three),
r AS (SELECT *, sqrt(greatest(0.0, 1 - (v[1]*v[1]+v[2]*v[2]+v[3]*v[3]))) AS r FROM v),
o AS (SELECT clip, frame, joint, list_concat(list_concat(v[1:p-1], [r]), v[p:3]) AS q, sqrt(v[1]*v[1]+v[2]*v[2]+v[3]*v[3]+r*r) AS n FROM r)
""" + "SELECT clip, frame, joint, " + four_sql([f"q[{k}]/n" for k in (1, 2, 3, 4)]) + " FROM o")
def from_smallest_three(spark, sf):
    omitted, three = codes.smallest_three(Q.quat(), 16)
    rows = V.pose_quat(spark, sf).select(*KEY, omitted.alias("omitted"), three.alias("c"))
    back = codes.from_smallest_three(F.col("omitted"), F.col("c"), 16)
    return rows.select(*KEY, *Q.named(back)).select(*KEY, *four(Q.normalize(Q.quat())))


_RANGE = ",\nb AS (SELECT *, min(v) OVER (PARTITION BY clip) AS lo, max(v) OVER (PARTITION BY clip) AS hi FROM scalar_track)\n"
_CODE = "CASE WHEN hi > lo THEN CAST(round_even(least(1.0, greatest(0.0, (v-lo)/(hi-lo))) * 4095, 0) AS BIGINT) ELSE 0 END"


def ranged(spark, sf):
    bounds = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("clip")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return V.scalar_track(spark, sf).join(bounds, "clip")


@query("PRJ13", using("scalar_track") + _RANGE + f"SELECT clip, frame, {_CODE} AS code FROM b")
def quantize(spark, sf):
    return ranged(spark, sf).select("clip", "frame", codes.quantize(F.col("v"), F.col("lo"), F.col("hi"), 12).alias("code"))


@query("PRJ14", using("scalar_track") + _RANGE + "SELECT clip, frame, " + m(f"lo + ({_CODE}) / 4095.0::DOUBLE * (hi - lo)", "value") + " FROM b")
def dequantize(spark, sf):
    code = codes.quantize(F.col("v"), F.col("lo"), F.col("hi"), 12)
    return ranged(spark, sf).select("clip", "frame", micro(codes.dequantize(code, F.col("lo"), F.col("hi"), 12), "value"))


@query("PRJ15", using("sparse_keys") + ",\nd AS (SELECT clip, frame, frame - coalesce(lag(frame) OVER (PARTITION BY clip ORDER BY frame), 0) AS delta FROM sparse_keys)\nSELECT clip, count(*) AS n, sum(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 ELSE 3 END)::BIGINT AS bytes FROM d GROUP BY clip")
def delta_bytes(spark, sf):
    from pyspark.sql import Window

    delta = F.col("frame") - F.lag("frame", 1, 0).over(Window.partitionBy("clip").orderBy("frame"))
    rows = V.sparse_keys(spark, sf).select("clip", codes.varuint_bytes(delta).alias("b"))
    return rows.groupBy("clip").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


_NAMES = "names AS (SELECT DISTINCT 'src' || (user_id % 3) || ':' || event_type || '_' || (user_id % 7) AS name FROM events UNION SELECT name FROM toy UNION SELECT name FROM engine UNION SELECT 'rig: ' || name || '.L ' FROM toy)"
_PLAIN = "regexp_replace(lower(list_last(string_split(name, ':'))), '[^a-z0-9]', '', 'g')"


def all_names(spark, sf):
    events = V.table(spark, sf, "events").select(F.concat(F.lit("src"), F.col("user_id") % 3, F.lit(":"), "event_type", F.lit("_"), F.col("user_id") % 7).alias("name"))
    toy, engine = skeleton(spark, TOY).select("name"), skeleton(spark, ENGINE).select("name")
    rig = toy.select(F.concat(F.lit("rig: "), "name", F.lit(".L ")).alias("name"))
    return events.union(toy).union(engine).union(rig).distinct()


@query("PRJ20", using("toy", "engine") + f",\n{_NAMES}\nSELECT name, trim(list_last(string_split(name, ':'))) AS local, {_PLAIN} AS plain FROM names")
def name_parts(spark, sf):
    return all_names(spark, sf).select("name", names.local_name(F.col("name")).alias("local"), names.plain_name(F.col("name")).alias("plain"))


ALIAS_SQL = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in names.ALIASES.items()) + ") v(plain, what))"


def meaning_sql(name: str = "name") -> str:
    p = f"regexp_replace(lower(list_last(string_split({name}, ':'))), '[^a-z0-9]', '', 'g')"
    p = f"(CASE WHEN starts_with({p}, 'mixamorig') THEN substr({p}, 10) ELSE {p} END)"
    return f"(CASE WHEN starts_with({p}, 'spine') THEN 'spine' WHEN contains({p}, 'twist') THEN 'twist:' || {p} ELSE coalesce((SELECT what FROM alias a WHERE a.plain = {p}), {p}) END)"


@query("PRJ21", using("toy", "engine") + f",\n{_NAMES},\n{ALIAS_SQL}\nSELECT name, {meaning_sql()} AS what FROM names")
def meanings(spark, sf):
    return all_names(spark, sf).select("name", names.meaning(F.col("name")).alias("what"))


_COLLAR = "rig AS (SELECT 'a' AS skeleton, unnest(['pelvis', 'left_collar', 'left_shoulder', 'right_shoulder']) AS name UNION ALL SELECT 'b', unnest(['Hips', 'LeftShoulder', 'LeftArm', 'RightShoulder']) UNION ALL SELECT 'c', name FROM toy)"


@query("PRJ22", using("toy") + f",\n{_COLLAR},\n{ALIAS_SQL},\nf AS (SELECT *, bool_or({_PLAIN} IN ('leftcollar', 'rightcollar')) OVER (PARTITION BY skeleton) AS collars FROM rig)\nSELECT skeleton, name, CASE WHEN collars AND {_PLAIN} = 'leftshoulder' THEN 'left_upper_arm' WHEN collars AND {_PLAIN} = 'rightshoulder' THEN 'right_upper_arm' ELSE {meaning_sql()} END AS what FROM f")
def meanings_in(spark, sf):
    from pyspark.sql import Window

    rows = [("a", n) for n in ("pelvis", "left_collar", "left_shoulder", "right_shoulder")] + [("b", n) for n in ("Hips", "LeftShoulder", "LeftArm", "RightShoulder")] + [("c", n) for n, _, _ in TOY]
    df = spark.createDataFrame(rows, "skeleton string, name string")
    collars = F.bool_or(names.plain_name(F.col("name")).isin("leftcollar", "rightcollar")).over(Window.partitionBy("skeleton"))
    return df.withColumn("collars", collars).select("skeleton", "name", names.meaning_in(F.col("name"), F.col("collars")).alias("what"))


@query("PRJ24", using("eval_sample") + "\nSELECT sample, split FROM eval_sample")
def splits(spark, sf):
    return V.eval_sample(spark, sf).select("sample", V.split(F.col("character_seen"), F.col("motion_seen")).alias("split"))


@query("PRJ26", PQ + PAIR + "qx::FLOAT AS x, qy::FLOAT AS y, qz::FLOAT AS z, qw::FLOAT AS w FROM pose_quat")
def output_pose(spark, sf):
    return V.pose_quat(spark, sf).select(*KEY, *[F.col(f"q{c}").cast("float").alias(c) for c in "xyzw"])


@query("PRJ27", using("scalar_track", "track_size") + "\nSELECT s.clip, CAST(s.frame // 2 AS INTEGER) AS frame, s.v FROM scalar_track s JOIN track_size t ON s.clip = t.clip WHERE s.frame % 2 = 0 AND s.frame // 2 < ((t.n + 1) // 2 // 4) * 4")
def stride(spark, sf):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("clip"))
    rows = V.scalar_track(spark, sf).where("frame % 2 = 0").withColumn("n", n)
    return rows.where("frame div 2 < (n div 4) * 4").select("clip", F.expr("frame div 2").cast("int").alias("frame"), "v")


