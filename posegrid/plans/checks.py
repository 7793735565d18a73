"""Rules (FLT), gates (GATE), evaluation (EVAL), sets (SET), orders (ORD), listings (SRC, SNK)."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from posegrid.functions import quat as Q
from posegrid.operators import constraints as C
from posegrid.operators import scene
from posegrid.plans import views as V
from posegrid.plans.registry import m, micro, query, using
from posegrid.plans.windows import METRICS, NINE, SPLITS, nine_metrics, split_report

DATASETS, METHODS = ["Mixamo", "Manny", "SMPL", "MetaHuman"], ["copy", "model", "manual"]

_MAN = """man AS (SELECT o_orderkey AS sample, CASE WHEN o_orderkey % 11 = 0 THEN '0.2.0' ELSE '0.1.0' END AS schema_version,
  CASE o_orderkey % 5 WHEN 0 THEN 'Mixamo' WHEN 1 THEN 'Manny' WHEN 2 THEN 'SMPL' WHEN 3 THEN 'MetaHuman' ELSE 'Private' END AS dataset,
  CASE o_orderkey % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'model' ELSE 'manual' END AS method, 'retargeting' AS quality_layer,
  CASE WHEN o_orderkey % 13 = 0 THEN 'artist_gold' ELSE 'automatic' END AS track, o_orderkey % 17 = 0 AS per_animation_adjustment, 'skeleton' AS configuration_scope,
  CAST(20 + o_orderkey % 3 AS INTEGER) AS joint_count, CAST(o_orderkey % 23 AS INTEGER) AS root_index, (o_orderkey % 7) * 0.3::DOUBLE AS character_height,
  CASE WHEN o_orderkey % 19 = 0 THEN '/abs/a.npz' WHEN o_orderkey % 29 = 0 THEN 'public_data/../x' ELSE 'public_data/' || o_orderkey || '.npz' END AS prediction_path,
  CASE WHEN o_orderkey % 31 = 0 THEN 'c:\\\\x' ELSE 'public_data/gt/' || o_orderkey END AS ground_truth_path,
  CASE WHEN o_orderkey % 37 = 0 THEN 'zz' ELSE sha256((o_custkey % 9)::VARCHAR) END AS skeleton_config_sha256,
  CASE WHEN o_orderkey % 41 = 0 THEN 'http://a.example' ELSE 'https://a.example/x' END AS provenance_url, CASE WHEN o_orderkey % 43 = 0 THEN '  ' ELSE 'public' END AS license_note,
  'cfg' || (o_custkey % 9) AS skeleton_config_id, CAST(o_custkey % 50 AS VARCHAR) AS target_character_id FROM orders)""".replace("\\\\\\\\", "\\")


def manifest(spark, sf):
    """Evaluation records made of the orders, some of which break rules."""
    k = F.col("o_orderkey")
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (k % n).cast("int") + 1)
    odd = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    return V.table(spark, sf, "orders").select(
        k.alias("sample"), odd(11, F.lit("0.2.0"), F.lit("0.1.0")).alias("schema_version"), pick(5, [*DATASETS, "Private"]).alias("dataset"), pick(3, METHODS).alias("method"),
        F.lit("retargeting").alias("quality_layer"), odd(13, F.lit("artist_gold"), F.lit("automatic")).alias("track"), (k % 17 == 0).alias("per_animation_adjustment"),
        F.lit("skeleton").alias("configuration_scope"), (20 + k % 3).cast("int").alias("joint_count"), (k % 23).cast("int").alias("root_index"), ((k % 7) * F.lit(0.3)).alias("character_height"),
        F.when(k % 19 == 0, "/abs/a.npz").when(k % 29 == 0, "public_data/../x").otherwise(F.concat(F.lit("public_data/"), k, F.lit(".npz"))).alias("prediction_path"),
        odd(31, F.lit("c:\\x"), F.concat(F.lit("public_data/gt/"), k)).alias("ground_truth_path"), odd(37, F.lit("zz"), F.sha2((F.col("o_custkey") % 9).cast("string"), 256)).alias("skeleton_config_sha256"),
        odd(41, F.lit("http://a.example"), F.lit("https://a.example/x")).alias("provenance_url"), odd(43, F.lit("  "), F.lit("public")).alias("license_note"),
        F.concat(F.lit("cfg"), F.col("o_custkey") % 9).alias("skeleton_config_id"), (F.col("o_custkey") % 50).cast("string").alias("target_character_id"),
    )


_BAD = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({rule}) THEN '{name}' END" for name, rule in {
    "schema_version": "schema_version = '0.1.0'", "dataset": "dataset IN ('Mixamo', 'Manny', 'SMPL', 'MetaHuman')", "method": "method IN ('copy', 'model', 'manual')",
    "quality_layer": "quality_layer IN ('retargeting', 'codec_roundtrip', 'artist_gold')", "track": "track IN ('automatic', 'artist_gold')",
    "adjustment": "track <> 'automatic' OR NOT per_animation_adjustment", "gold": "track <> 'artist_gold' OR quality_layer = 'artist_gold'", "scope": "configuration_scope = 'skeleton'",
    "joints": "joint_count > 0 AND (dataset <> 'Mixamo' OR quality_layer <> 'retargeting' OR joint_count = 22)", "root": "root_index >= 0 AND root_index < joint_count", "height": "character_height > 0",
    "prediction_path": "prediction_path LIKE 'public_data/%' AND NOT contains(prediction_path, '..')", "ground_truth_path": "ground_truth_path LIKE 'public_data/%' AND NOT contains(ground_truth_path, ':')",
    "sha256": "length(skeleton_config_sha256) = 64", "provenance": "starts_with(provenance_url, 'https://')", "license": "trim(license_note) <> ''",
}.items()) + ")"


@query("FLT1", f"WITH {_MAN}\nSELECT sample, {_BAD} AS violations FROM man WHERE {_BAD} <> ''")
def flt1(spark, sf):
    bad = F.array_join(C.violations(C.manifest_rules(DATASETS, METHODS)), ",")
    return manifest(spark, sf).select("sample", bad.alias("violations")).where("violations <> ''")


@query("SRC5", f"WITH {_MAN},\nok AS (SELECT * FROM man WHERE {_BAD} = '')\nSELECT count(*) AS records, count(DISTINCT sample) AS ids, count(DISTINCT quality_layer) AS layers, count(DISTINCT track) AS tracks FROM ok")
def src5(spark, sf):
    """The records that a manifest may hold, with what must be single in a run: read from JSON lines."""
    rows = manifest(spark, sf)
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
    back = lines.where("trim(line) <> ''").select(F.from_json("line", rows.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    ok = back.where(F.size(C.violations(C.manifest_rules(DATASETS, METHODS))) == 0)
    return ok.agg(F.count("*").alias("records"), F.count_distinct("sample").alias("ids"), F.count_distinct("quality_layer").alias("layers"), F.count_distinct("track").alias("tracks"))


@query("FLT2", f"WITH {_MAN}\nSELECT sample, prediction_path LIKE 'public_data/%' AND NOT contains(prediction_path, '..') AS ok FROM man")
def flt2(spark, sf):
    return manifest(spark, sf).select("sample", C.relative_path(F.col("prediction_path")).alias("ok"))


@query("FLT3", f"WITH {_MAN}\nSELECT sample, regexp_full_match(skeleton_config_sha256, '[0-9a-fA-F]{{64}}') AS ok FROM man")
def flt3(spark, sf):
    return manifest(spark, sf).select("sample", C.sha256_hex(F.col("skeleton_config_sha256")).alias("ok"))


@query("AGG23", f"WITH {_MAN}\nSELECT dataset, target_character_id, count(DISTINCT (skeleton_config_id, skeleton_config_sha256)) AS configs FROM man GROUP BY ALL HAVING count(DISTINCT (skeleton_config_id, skeleton_config_sha256)) > 1")
def agg23(spark, sf):
    """Characters whose configuration changes within a run."""
    one = manifest(spark, sf).select("dataset", "target_character_id", "skeleton_config_id", "skeleton_config_sha256").distinct()
    return one.groupBy("dataset", "target_character_id").agg(F.count("*").alias("configs")).where("configs > 1")


@query("AGG24", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg24(spark, sf):
    """Identifiers that occur twice."""
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("FLT7", "SELECT p_partkey, p_name FROM part WHERE NOT contains(lower(p_name), 'a')")
def flt7(spark, sf):
    """Joints whose name lacks a word; here parts without the letter."""
    return V.table(spark, sf, "part").where(~F.contains(F.lower("p_name"), F.lit("a"))).select("p_partkey", "p_name")


@query("FLT11", "WITH f AS (SELECT o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_gt' ELSE '' END || '.bvh' AS path FROM orders)\nSELECT path FROM f WHERE NOT ends_with(path, '_gt.bvh')")
def flt11(spark, sf):
    end = F.when(F.col("o_orderkey") % 2 == 0, "_gt").otherwise("")
    return V.table(spark, sf, "orders").select(F.concat("o_orderkey", end, F.lit(".bvh")).alias("path")).where(~F.endswith("path", F.lit("_gt.bvh")))


_NEED = ["input", "output", "preset"]
_STEP = "CASE s WHEN '' THEN 0 WHEN '.' THEN 0 WHEN '..' THEN -1 ELSE 1 END"


@query("FLT12", f"""WITH a AS (SELECT event_id, list_filter([CASE WHEN event_id % 3 > 0 THEN 'input' END, CASE WHEN event_id % 5 > 0 THEN 'output' END, 'preset', CASE WHEN event_id % 7 = 0 THEN event_type END], lambda x: x IS NOT NULL) AS given,
  CASE event_id % 6 WHEN 0 THEN '/abs/' || event_type WHEN 1 THEN 'a/../../' || event_type WHEN 2 THEN 'a/./b/../' || event_type WHEN 3 THEN '' ELSE 'out/' || event_type END AS path, event_id % 4 = 0 AS there, event_id % 8 = 0 AS overwrite FROM events),
p AS (SELECT a.*, list_transform(string_split(path, '/'), lambda s: {_STEP}) AS steps FROM a),
q AS (SELECT p.*, path = '' OR starts_with(path, '/') OR list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) < 0 AS outside FROM p)
SELECT event_id, array_to_string(list_filter(['input', 'output', 'preset'], lambda x: NOT list_contains(given, x)), ',') AS missing, array_to_string(list_filter(given, lambda x: NOT list_contains(['input', 'output', 'preset'], x)), ',') AS unknown,
  outside, NOT outside AND there AND NOT overwrite AS kept_from_overwriting FROM q""")
def flt12(spark, sf):
    """Argument names that are missing and that nobody asked for, output paths that leave the workspace, and those that may not be overwritten."""
    k = F.col("event_id")
    given = F.array_compact(F.array(F.when(k % 3 > 0, "input"), F.when(k % 5 > 0, "output"), F.lit("preset"), F.when(k % 7 == 0, F.col("event_type"))))
    need = F.array(*map(F.lit, _NEED))
    at = lambda before: F.concat(F.lit(before), "event_type")
    path = F.when(k % 6 == 0, at("/abs/")).when(k % 6 == 1, at("a/../../")).when(k % 6 == 2, at("a/./b/../")).when(k % 6 == 3, "").otherwise(at("out/"))
    rows = V.table(spark, sf, "events").select("event_id", given.alias("g"), (~C.inside_workspace(path)).alias("outside"), (k % 4 == 0).alias("there"), (k % 8 == 0).alias("overwrite"))
    return rows.select(
        "event_id", F.array_join(F.array_except(need, F.col("g")), ",").alias("missing"), F.array_join(F.array_except(F.col("g"), need), ",").alias("unknown"),
        "outside", (~F.col("outside") & F.col("there") & ~F.col("overwrite")).alias("kept_from_overwriting"),
    )


@query("SET3", "SELECT DISTINCT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set3(spark, sf):
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("part")).subtract(V.table(spark, sf, "lineitem").where("l_quantity > 40").select("l_partkey"))


_DEG = 'degrees(2*acos(least(1.0::DOUBLE, abs(aw*bw+ax*bx+ay*"by"+az*bz))))'
_GATE = f"me AS (SELECT clip, max({_DEG}) AS rotation, avg({_DEG}) AS mean_rotation, count(*)::DOUBLE AS n FROM quat_pair GROUP BY clip), ch AS (SELECT clip, 'rotation' AS id, rotation AS actual, '<=' AS comparator, 179.0::DOUBLE AS lim, rotation <= 179.0 AS passed FROM me UNION ALL SELECT clip, 'mean_rotation', mean_rotation, '<=', 118.0, mean_rotation <= 118.0 FROM me UNION ALL SELECT clip, 'n', n, '>=', 700, n >= 700 FROM me)"
LIMITS = {"rotation": ("<=", 179.0), "mean_rotation": ("<=", 118.0), "n": (">=", 700.0)}


def measures(spark, sf):
    e = Q.angle_degrees(Q.quat("a"), Q.quat("b"))
    rows = V.quat_pair(spark, sf).select("clip", e.alias("e"))
    return rows.groupBy("clip").agg(F.max("e").alias("rotation"), F.avg("e").alias("mean_rotation"), F.count("*").alias("n"))


@query("FLT9", using("quat_pair") + f",\n{_GATE}\nSELECT clip, id, {m('actual', 'actual', '1e3')}, comparator, passed FROM ch")
def flt9(spark, sf):
    return C.gate(measures(spark, sf), LIMITS, ["clip"]).select("clip", "id", micro(F.col("actual"), "actual", 1e3), "comparator", "passed")


@query("AGG18", using("quat_pair") + f",\n{_GATE}\nSELECT clip, bool_and(passed) AS passed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT passed), '') AS failed FROM ch GROUP BY clip")
def agg18(spark, sf):
    return C.verdict(C.gate(measures(spark, sf), LIMITS, ["clip"]), ["clip"])


@query("SNK6", using("quat_pair") + f",\n{_GATE}\nSELECT clip, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed FROM ch GROUP BY clip")
def snk6(spark, sf):
    """A report a clip as sorted JSON, read back."""
    rows = C.gate(measures(spark, sf), LIMITS, ["clip"]).groupBy("clip").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("id", "passed"))).alias("checks"))).alias("j"))
    back = rows.select("clip", F.from_json("j", "checks array<struct<id: string, passed: boolean>>")["checks"].alias("c"))
    return back.select("clip", F.size("c").cast("long").alias("checks"), F.size(F.filter("c", lambda x: x["passed"])).cast("long").alias("passed"))


@query("GATE3", "SELECT user_id AS clip, CASE WHEN user_id % 5 = user_id % 3 THEN 'same_character' ELSE 'different_character' END AS kind FROM (SELECT DISTINCT user_id FROM events)")
def gate3(spark, sf):
    """Equal content hashes make a same-character case."""
    clips = V.table(spark, sf, "events").select(F.col("user_id").alias("clip")).distinct()
    h = lambda n: F.sha2((F.col("clip") % n).cast("string"), 256)
    return clips.select("clip", F.when(h(5) == h(3), "same_character").otherwise("different_character").alias("kind"))


_EV = "ev AS (SELECT CASE WHEN clip % 2 = 0 THEN 'seen' ELSE 'unseen' END || '_character_' || CASE WHEN clip % 3 = 0 THEN 'seen' ELSE 'unseen' END || '_motion' AS split, * FROM nine), gr AS (SELECT coalesce(split, 'overall') AS split, count(*) AS n, " + ", ".join(f"avg({c}) AS {c}" for c in METRICS) + " FROM ev GROUP BY GROUPING SETS ((split), ())), every AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in [*SPLITS, "overall"]) + ") v(split))"


@query("EVAL1", NINE.rstrip() + f",\n{_EV}\nSELECT every.split, coalesce(n, 0) AS n, " + ", ".join(m(c, c, "1e4") for c in METRICS) + " FROM every LEFT JOIN gr ON gr.split = every.split")
def eval1(spark, sf):
    """All nine metrics of every clip and their means over the groups of an evaluation, in one plan."""
    rows = nine_metrics(spark, sf).withColumn("split", V.split(F.col("clip") % 2 == 0, F.col("clip") % 3 == 0))
    return split_report(rows, SPLITS, METRICS).select("split", "n", *[micro(F.col(c), c, 1e4) for c in METRICS])


@query("SET1", "SELECT event_type AS name, count(DISTINCT user_id % 8) AS characters FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 8) = 8")
def set1(spark, sf):
    """Names that every character has."""
    pairs = V.table(spark, sf, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 8).alias("c")).distinct()
    return pairs.groupBy("name").agg(F.count("*").alias("characters")).where("characters = 8")


@query("SET4", "SELECT l_shipdate::DATE::VARCHAR AS finding FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderdate::DATE::VARCHAR FROM orders WHERE o_totalprice > 300000")
def set4(spark, sf):
    a = V.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("finding"))
    return a.union(V.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.date_format("o_orderdate", "yyyy-MM-dd"))).distinct()


@query("SET5", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def set5(spark, sf):
    return V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).unionAll(V.table(spark, sf, "nation").select("n_nationkey"))


@query("ORD1", using("sparse_keys") + "\nSELECT clip, array_to_string(list(frame ORDER BY frame), ',') AS frames FROM sparse_keys GROUP BY clip")
def ord1(spark, sf):
    rows = V.sparse_keys(spark, sf).groupBy("clip").agg(F.sort_array(F.collect_list("frame")).alias("f"))  # the keys of one track
    return rows.select("clip", F.array_join("f", ",").alias("frames"))


@query("ORD2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ord2(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


_DRAWN = random.Random(20260801).sample(range(25), 8)  # the places of a seeded sample of the 25 nations


@query("ORD4", f"SELECT n_name AS name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS place FROM nation) WHERE place IN ({', '.join(map(str, _DRAWN))})")
def ord4(spark, sf):
    """A seeded sample of names without replacement, drawn by the driver from a short sorted list."""
    names = sorted(r[0] for r in V.table(spark, sf, "nation").select("n_name").collect())  # a short dimension
    return spark.createDataFrame([(n,) for n in random.Random(20260801).sample(names, 8)], "name string")


@query("SRC4", using("sparse_keys") + "\nSELECT clip, count(*) AS keys, CAST(max(frame) AS INTEGER) AS last FROM sparse_keys GROUP BY clip")
def src4(spark, sf):
    """Metadata documents read without their tracks: key counts are summed from the JSON."""
    rows = V.sparse_keys(spark, sf).withColumn("part", F.col("frame") % 3).groupBy("clip", "part").agg(F.count("*").alias("n"), F.max("frame").alias("last"))
    text = rows.groupBy("clip").agg(F.to_json(F.struct(F.collect_list("n").alias("counts"), F.max("last").alias("last"))).alias("meta"))
    read = text.select("clip", F.from_json("meta", "counts array<bigint>, last int").alias("m"))
    return read.select("clip", F.aggregate("m.counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"), "m.last")


_LIST = "f AS (SELECT 'clips/' || (c_nationkey % 4) || '/' || c_custkey || '.bvh' AS path FROM customer)"


@query("SRC10", f"WITH {_LIST}\nSELECT split_part(path, '/', 2) AS character, count(*) AS files, min(regexp_extract(path, '(\\d+)\\.bvh$', 1)::BIGINT) AS first FROM f GROUP BY 1")
def src10(spark, sf):
    """Files by character, in the order of their numbers."""
    path = F.concat(F.lit("clips/"), F.col("c_nationkey") % 4, F.lit("/"), "c_custkey", F.lit(".bvh"))
    rows = V.table(spark, sf, "customer").select(path.alias("path"))
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("character")).agg(F.count("*").alias("files"), F.min(F.regexp_extract("path", r"(\d+)\.bvh$", 1).cast("long")).alias("first"))


@query("SNK7", using("pair_score") + "\nSELECT source, target, count(*) AS clips FROM (SELECT DISTINCT source, target, clip FROM pair_score) GROUP BY ALL")
def snk7(spark, sf):
    """The rows of a complete matrix; an incomplete one is an error."""
    cells = V.pair_score(spark, sf).distinct().select("source", "target", "clip").distinct().groupBy("source", "target").agg(F.count("*").alias("clips"))
    sizes = cells.agg(F.count("*").alias("have"), (F.count_distinct("source") * F.count_distinct("target")).alias("due"))
    cells = cells.join(F.broadcast(sizes))  # one row
    whole = F.col("have") == F.col("due")
    return cells.withColumn("ok", F.when(whole, True).otherwise(F.raise_error(F.lit("the matrix is not complete")).cast("boolean"))).where("ok").drop("ok", "have", "due")


@query("SNK9", """WITH f AS (SELECT 'docs/' || doc_id AS path, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS sha FROM documents),
l AS (SELECT substr(sha256(path), 1, 4) AS leaf, count(*) AS files, sum(size)::BIGINT AS bytes, sha256(string_agg(path || chr(31) || size || chr(31) || sha || chr(10), '' ORDER BY path)) AS sha FROM f GROUP BY 1)
SELECT sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sha256(string_agg(leaf || sha || chr(10), '' ORDER BY leaf)) AS tree FROM l""")
def snk9(spark, sf):
    """Sizes and digests of all files as a tree of two levels: a leaf is the sorted list of the files whose path
    hashes to it, the root the sorted list of the 65,536 leaves at most. So no list of all files is made."""
    rows = V.table(spark, sf, "documents").select(F.concat(F.lit("docs/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("path", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha"))
    line = F.concat("path", F.lit(chr(31)), F.col("size").cast("string"), F.lit(chr(31)), "sha", F.lit("\n"))
    sorted_ = lambda key, text: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), text.alias("t")))), lambda x: x["t"]), ""), 256)
    leaves = rows.groupBy(F.substring(F.sha2("path", 256), 1, 4).alias("leaf")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), sorted_("path", line).alias("sha"))
    return leaves.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), sorted_("leaf", F.concat("leaf", "sha", F.lit("\n"))).alias("tree"))


@query("AGG26", """WITH o AS (SELECT l_orderkey AS scene, ['ARMATURE', 'MESH', 'ACTION', 'IMAGE'][l_linenumber % 4 + 1] AS kind, l_orderkey || '-' || l_linenumber AS name, CAST(l_quantity AS BIGINT) AS n,
  ['m' || l_partkey % 40, 'm' || l_suppkey % 40] AS materials, l_returnflag = 'A' AS packed, l_linestatus = 'O' AS found FROM lineitem),
a AS (SELECT scene, count(*) FILTER (WHERE kind = 'ARMATURE') AS armature_count, CAST(coalesce(sum(n) FILTER (WHERE kind = 'ARMATURE'), 0) AS BIGINT) AS bone_count, count(*) FILTER (WHERE kind = 'MESH') AS mesh_count,
  count(*) FILTER (WHERE kind = 'ACTION') AS action_count, CAST(coalesce(sum(n) FILTER (WHERE kind = 'ACTION'), 0) AS BIGINT) AS keyframe_count,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'IMAGE' AND NOT packed AND NOT found), '') AS missing FROM o GROUP BY scene),
s AS (SELECT scene, count(DISTINCT material) AS material_count FROM (SELECT scene, unnest(materials) AS material FROM o WHERE kind = 'MESH') GROUP BY scene)
SELECT a.*, coalesce(material_count, 0) AS material_count FROM a LEFT JOIN s USING (scene)""")
def agg26(spark, sf):
    """Scene counts; the lines of an order stand in for the objects of a scene."""
    named = lambda c: F.concat(F.lit("m"), F.col(c) % 40)
    kinds = F.array(*map(F.lit, ("ARMATURE", "MESH", "ACTION", "IMAGE")))
    return scene.scene_summary(V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene"), F.get(kinds, (F.col("l_linenumber") % 4).cast("int")).alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"),
        F.col("l_quantity").cast("long").alias("n"), F.array(named("l_partkey"), named("l_suppkey")).alias("materials"), (F.col("l_returnflag") == "A").alias("packed"), (F.col("l_linestatus") == "O").alias("found"),
    ))
